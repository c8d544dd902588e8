"""SentencePiece encoding by vectorised merge rounds, and decoding.

A BPE model joins, again and again, the neighbouring symbols whose joint piece has the
best score, the leftmost of equals. No merge crosses two characters that stand side by
side in no piece, so a text falls into segments there (blanks among them) and each
segment is merged alone. All segments of a batch lie in flat numpy arrays. A round takes
the least pair rank of each segment, merges its occurrences from the left, updates the
ranks beside them and compacts the arrays, until no pair remains. Occurrences after one
whose merge creates a pair of the same or a better rank wait for the next round, as the
library would turn to that pair first; so the ids are the library's.

Words are remembered, so only new ones enter the rounds. Characters without a piece of
their own become byte pieces. Decoding joins the pieces' bytes; ids that do not spell
valid text, and the unknown id, go to the library.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import pieces, text_bytes

# --- fixed values of the model file's format ---------------------------------
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
SPACE = "\u2581"

NO_PAIR = np.iinfo(np.int32).max
PIECE_BYTES = 2 << 20
WORDS_KEPT, WORD_CHARS = 600_000, 48


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class MergeTable:
    """A model's pieces, and the rank and result of every pair of symbols that may merge.

    Takes BPE models with byte fallback whose normaliser leaves characters alone and whose
    pieces are normal, control, unknown and byte ones; raises ValueError on others.
    """

    def __init__(self, path: str):
        with open(path, "rb") as source:
            raw = source.read()
        pieces, scores, kinds = [], [], []
        trainer, normaliser = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                one = dict(_fields(value))
                pieces.append(one[1].decode())
                scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                kinds.append(one.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3) != BPE or not trainer.get(35) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("not a BPE model with byte fallback and plain pieces")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1) or trainer.get(24):
            raise ValueError("the model's normaliser changes more than blanks")
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.byte_ids = np.zeros(256, np.uint32)
        self.surface: list[bytes | None] = []
        for k, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == BYTE:
                self.byte_ids[int(piece[3:-1], 16)] = k
                self.surface.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.surface.append({NORMAL: piece.replace(SPACE, " ").encode(), CONTROL: b""}.get(kind))
        self.leads = {k for k, (p, kind) in enumerate(zip(pieces, kinds, strict=True)) if kind == NORMAL and p.startswith(SPACE)}

        normal = {p: k for k, (p, kind) in enumerate(zip(pieces, kinds, strict=True)) if kind == NORMAL}
        self.n_pieces = len(pieces)
        chars = sorted(set("".join(normal)))
        # symbols: the pieces by id, then characters of pieces that are none themselves; -1 is any other character
        symbols = dict(normal)
        for c in chars:
            symbols.setdefault(c, len(pieces) + len(symbols) - len(normal))
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.symbol_of[[ord(c) for c in chars]] = [symbols[c] for c in chars]
        self.width = len(pieces) + len(symbols) - len(normal)
        rank_of = {s: r for r, s in enumerate(sorted({scores[k] for k in normal.values()}, reverse=True))}
        keys, ranks, results, beside = [], [], [], set()
        for piece, k in normal.items():
            beside.update(zip(piece, piece[1:], strict=False))
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    ranks.append(rank_of[scores[k]])
                    results.append(k)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int32)[order]
        self.results = np.array(results, np.int32)[order]
        self.beside = np.sort(np.array([symbols[a] * self.width + symbols[b] for a, b in beside], np.int64))
        # blanks end a segment unless a piece holds one behind another character
        self.words_end_at_blanks = not any(b == SPACE != a for a, b in beside)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and resulting symbol of each pair; ``NO_PAIR`` where it does not merge."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NO_PAIR), np.where(found, self.results[at], -1)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the two characters stand side by side in some piece."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        return self.beside[at] == key


def merge_rounds(table: MergeTable, symbol: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Merge all segments to the end; gives the symbol at each place, and -2 where one was merged away.

    ``segment`` numbers each place's segment in ascending order.
    """
    out = symbol.copy()
    place = np.arange(len(symbol))
    rank, result = np.full(len(symbol), NO_PAIR, np.int32), np.full(len(symbol), -1, np.int32)
    inner = np.flatnonzero(segment[1:] == segment[:-1])
    rank[inner], result[inner] = table.pairs(symbol[inner], symbol[inner + 1])
    while len(symbol):
        begins = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        sizes = np.diff(np.append(begins, len(symbol)))
        least = np.minimum.reduceat(rank, begins)
        open_ = np.repeat(least != NO_PAIR, sizes)
        if not open_.all():  # compaction: finished segments leave
            out[place[~open_]] = symbol[~open_]
            symbol, segment, place, rank, result = (x[open_] for x in (symbol, segment, place, rank, result))
            if not len(symbol):
                break
            begins = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            sizes = np.diff(np.append(begins, len(symbol)))
            least = least[least != NO_PAIR]
        number = np.repeat(np.arange(len(begins)), sizes)
        at = np.flatnonzero(rank == least[number])
        # of overlapping occurrences every other one, from the left
        fresh = np.concatenate([[True], np.diff(at) != 1])
        since = at - at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        at = at[since % 2 == 0]
        made, mine, of = result[at], rank[at], number[at]
        # ranks of the pairs that this merge would create
        behind = np.minimum(at + 2, len(symbol) - 1)
        has_next = (at + 2 < len(symbol)) & (number[behind] == of)
        right = np.where(has_next, table.pairs(made, symbol[behind])[0], NO_PAIR)
        before = np.maximum(at - 1, 0)
        has_last = (at > 0) & (number[before] == of)
        beside = np.concatenate([[False], np.diff(at) == 2]) & has_last
        last = np.where(beside, np.concatenate([made[:1], made[:-1]]), symbol[before])
        left = np.where(has_last, table.pairs(last, made)[0], NO_PAIR)
        sooner = (right <= mine) | (left <= mine)
        if sooner.any():
            seen = np.cumsum(sooner) - sooner
            first = np.concatenate([[True], of[1:] != of[:-1]])
            at_first = seen[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            at = at[seen == at_first]
            made = result[at]
        symbol[at] = made
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        out[place[at + 1]] = -2
        touched = np.zeros(len(symbol), bool)
        touched[at] = True
        touched[np.maximum(at - 1, 0)] = True
        touched[np.maximum(at - 2, 0)] = True  # its right neighbour may have been merged away
        symbol, segment, place, rank, result, touched = (x[keep] for x in (symbol, segment, place, rank, result, touched))
        again = np.flatnonzero(touched)
        rank[again], result[again] = NO_PAIR, -1
        again = again[again + 1 < len(symbol)]
        again = again[segment[again] == segment[again + 1]]
        rank[again], result[again] = table.pairs(symbol[again], symbol[again + 1])
    return out


class PieceCoder:
    """Encodes and decodes texts as the library does; remembers words."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.table = MergeTable(path)
        self.library = SentencePieceProcessor(model_file=path)
        self.known: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str]:
        """The text's words; one blank before a word is left out of it, others stand as blanks."""
        text = text.replace(SPACE, " ")
        if not self.table.words_end_at_blanks:
            return [" " + text]
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:] if w[0] == " " and w[1:2] not in ("", " ") else w for w in re.findall(" *[^ ]+| +", " " + text)]

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes."""
        spelled = [(w if w[0] == " " else " " + w).replace(" ", SPACE) for w in words]
        points = np.frombuffer("".join(spelled).encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        symbol = self.table.symbol_of[points]
        cut = np.zeros(len(points), bool)
        cut[np.cumsum(sizes) - sizes] = True
        cut[1:] |= ~self.table.joined(symbol[:-1], symbol[1:])
        merged = merge_rounds(self.table, symbol.copy(), np.cumsum(cut))
        left = np.flatnonzero(merged != -2)
        final, point = merged[left], points[left]
        spelled_out = (final < 0) | (final >= self.table.n_pieces)
        word = np.repeat(np.arange(len(words)), sizes)[left]
        ids = final.astype(np.uint32)
        if spelled_out.any():
            loose = np.flatnonzero(spelled_out)
            codes = [chr(p).encode() for p in point[loose].tolist()]
            times = np.ones(len(final), np.int64)
            times[loose] = [len(c) for c in codes]
            ids, word = np.repeat(ids, times), np.repeat(word, times)
            ids[np.repeat(spelled_out, times)] = self.table.byte_ids[np.frombuffer(b"".join(codes), np.uint8)]
        data = ids.astype("<u4").tobytes()
        ends = 4 * np.searchsorted(word, np.arange(len(words)), side="right")
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with begin and end ids."""
        split = [self._words(t) if t else [] for t in texts]
        new = list(set().union(*split).difference(self.known))
        known = self.known
        for _, part in pieces(new, PIECE_BYTES):
            known.update(zip(part, self._learn(part), strict=True))
        begin, end = (struct.pack("<I", k) for k in (self.table.begin, self.table.end))
        out = [b"".join((begin, *map(known.__getitem__, words), end)) for words in split]
        if len(known) > WORDS_KEPT:
            known.clear()
        else:
            for w in new:
                if len(w) > WORD_CHARS:
                    del known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text that the library decodes from the ids."""
        surface = self.table.surface
        try:
            text = b"".join([surface[k] for k in ids]).decode()
        except (TypeError, UnicodeDecodeError):
            return self.library.decode(ids)
        lead = next((k for k in ids if surface[k]), None)
        return text[1:] if lead in self.table.leads else text


_CODERS: dict[str, PieceCoder] = {}


def _coder(path: str) -> PieceCoder:
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(documents: DataFrame, model: str | None = None, decode: bool = False) -> DataFrame:
    """(doc_id, ids binary [, decoded string]) of each row: its whole text as little-endian 32-bit ids.

    ``decoded`` is what the ids spell again. A null text is empty and has the begin and
    end ids alone; a null doc_id stays null; repeated rows stay. No shuffle, and a task
    holds a few megabytes of texts beside its memory of words.
    """
    path = model or default_model()
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = _coder(path)
        for batch in batches:
            for at, part in pieces(batch.column(1).to_pylist(), PIECE_BYTES):
                codes = coder.encode_many([x.decode() for x in part])
                columns = [batch.column(0).slice(at, len(part)), pa.array(codes, pa.binary())]
                if decode:
                    columns.append(pa.array([coder.decode(np.frombuffer(c, "<u4").tolist()) for c in codes], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    schema = f"doc_id {kind}, ids binary" + (", decoded string" if decode else "")
    return documents.select("doc_id", text_bytes().alias("data")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids binary); null ids give a null text."""
    path = model or default_model()
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = _coder(path)
        for batch in batches:
            texts = [None if c is None else coder.decode(np.frombuffer(c, "<u4").tolist()) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def piece_report(documents: DataFrame, model: str | None = None) -> DataFrame:
    """Count and digest of each document's ids, and digest of the text decoded from them."""
    coded = encode_documents(documents, model, decode=True)
    return coded.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
