"""Token ids in binary files of bit-plane or byte-plane blocks.

A file holds blocks of a fixed number of 32-bit ids. A block is transposed into
planes: plane k holds bit (or byte) k of every id, so that the rarely set upper
planes shrink to almost nothing; each plane is one zstandard frame. After the
blocks come the document table (ids and lengths, zstandard) and the chunk index:
each block's offset, number of ids and plane sizes, so a reader can fetch any
block alone. A fixed-size trailer says where the index starts::

    block*  document table  chunk index  trailer

The job range-partitions documents by id, so files in order of (part, seq) hold
ids in ascending order of documents, and a document's place in the whole follows
from the files' counts alone.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import pieces, settle, text_bytes
from scriptorium.llm.files import fresh_name, make_folder, resolve
from scriptorium.session import new_path

BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 26
END_ID = 2
PIECE_BYTES = 2 << 20
MAGIC = b"IDPLANE1"
TRAILER = struct.Struct("<QQQ8s")  # offsets of document table and index, bytes of index, magic
PLANES = {"byte": 4, "bit": 32}


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Planes of little-endian 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The ids again."""
    columns = [np.frombuffer(p, np.uint8) for p in planes]
    if kind == "bit":
        bits = np.stack([np.unpackbits(c, count=n, bitorder="little") for c in columns], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    else:
        raw = np.stack(columns, axis=1)
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class TokenFileWriter:
    """Writes one file, a block at a time; holds at most one block and the lengths."""

    def __init__(self, sink, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        self.sink, self.kind, self.block_ids = sink, kind, block_ids
        self.pack = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.at = 0
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.chunks: list[list[int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block_ids:
            joined = np.concatenate(self.waiting)
            whole = len(joined) - len(joined) % self.block_ids
            for start in range(0, whole, self.block_ids):
                self._block(joined[start : start + self.block_ids])
            self.waiting, self.n_waiting = [joined[whole:]], len(joined) - whole

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        frames = [self.pack.compress(p) for p in to_planes(ids, self.kind)]
        self.chunks.append([self.at, len(ids), *map(len, frames)])
        self._write(b"".join(frames))

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        table_at = self.at
        table = {"kind": self.kind, "block_ids": self.block_ids, "docs": self.docs, "lengths": self.lengths}
        self._write(self.pack.compress(json.dumps(table).encode()))
        index_at = self.at
        index = np.array(self.chunks, "<u8").tobytes()
        self._write(index)
        self._write(TRAILER.pack(table_at, index_at, len(index), MAGIC))
        self.sink.close()


class TokenFile:
    """Reads a file's table and index, and then single blocks."""

    def __init__(self, source):
        self.source, size = source, source.size()
        table_at, index_at, index_bytes, magic = TRAILER.unpack(self._at(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.unpack = zstandard.ZstdDecompressor()
        table = json.loads(self.unpack.decompress(self._at(table_at, index_at - table_at)))
        self.kind, self.block_ids, self.docs, self.lengths = (table[k] for k in ("kind", "block_ids", "docs", "lengths"))
        self.index = np.frombuffer(self._at(index_at, index_bytes), "<u8").reshape(-1, 2 + PLANES[self.kind]).astype(np.int64)

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        offset, n, *sizes = self.index[k].tolist()
        data, planes, at = self._at(offset, sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.unpack.decompress(data[at : at + s]))
            at += s
        return from_planes(planes, n, self.kind)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Any stretch of ids, from the blocks it lies in."""
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        if n <= 0:
            return np.empty(0, "<u4")
        return np.concatenate([self.block(k) for k in range(first, last + 1)])[start - first * self.block_ids :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, number of ids, CRC-32 of the ids) in order, holding one block at a time."""
        k, block, at = 0, np.empty(0, "<u4"), 0
        for doc_id, n in zip(self.docs, self.lengths, strict=True):
            left, crc = n, 0
            while left:
                if at == len(block):
                    block, k, at = self.block(k), k + 1, 0
                took = block[at : at + left]
                crc = zlib.crc32(took.astype("<u4").tobytes(), crc)
                left, at = left - len(took), at + len(took)
            yield doc_id, n, crc


class CachedEncoder:
    """The tokenizers library with a memory of the pieces it has encoded.

    A single blank between two non-blank characters always ends a piece of a
    byte-level tokenizer, so a text is the sum of its blank-separated pieces and
    frequent ones are looked up; new ones go to the library laid end to end, some
    hundred in one text, and the ids are cut where the pieces end, which the tokens'
    byte lengths tell. Texts with other runs of blanks, or with a special token's string, go to
    the library whole. The memory is emptied when full.
    """

    ENTRIES, PIECE_CHARS, JOINED = 1_200_000, 64, 256

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character a byte
        self.sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        # piece -> its ids' bytes, or None if a text that has it must go whole
        self.inner: dict[str, bytes | None] = {}
        self.head: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, known: dict[str, bytes | None], pieces: set[str], lead: str, special: bool) -> list[str]:
        """Encode the pieces not known; gives those too long to be remembered."""
        new = list(pieces.difference(known))
        loose = [p for p in new if not p or (p != p.strip() if lead else p[-1].isspace())]
        if special:
            loose += [p for p in new if any(s in p for s in self.special)]
        known.update(dict.fromkeys(loose))
        left = [p for p in new if p not in known] if loose else new
        for at in range(0, len(left), self.JOINED):
            some = left[at : at + self.JOINED]
            known.update(zip(some, (self._joined(some, lead) if lead else None) or self._apart(some, lead), strict=True))
        return [p for p in new if len(p) > self.PIECE_CHARS]

    def _apart(self, some: list[str], lead: str) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([lead + p for p in some], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _joined(self, some: list[str], lead: str) -> list[bytes] | None:
        """The ids of each piece from one text of all; None if the tokens do not end where the pieces do."""
        whole = "".join([lead + p for p in some])
        ids = np.array(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(self.sizes[ids])
        wanted = np.cumsum(np.fromiter((len(p.encode()) for p in some), np.int64, len(some)) + len(lead.encode()))
        cuts = np.searchsorted(ends, wanted)
        if not len(ends) or ends[-1] != wanted[-1] or (ends[cuts] != wanted).any():
            return None
        data, cuts = ids.tobytes(), (4 * (cuts + 1)).tolist()
        return [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.split(" ") for t in texts]
        heads = {s[0] for s in split}
        inner = set().union(*(s[1:] for s in split))
        special = any(s in t for t in texts for s in self.special)
        once = [(self.head, p) for p in self._learn(self.head, heads, "", special)]
        once += [(self.inner, p) for p in self._learn(self.inner, inner, " ", special)]
        spaced = [x for x in self.special if " " in x]
        out, get = [], self.inner.get
        for text, (head, *rest) in zip(texts, split, strict=True):
            first = self.head[head]
            try:
                if first is None or any(x in text for x in spaced):
                    raise TypeError
                data = b"".join((first, *map(get, rest)))
            except TypeError:  # a piece without ids of its own
                data = self.whole(text)
            out.append(np.frombuffer(data, "<u4"))
        for known, p in once:
            known.pop(p, None)
        for known in (self.head, self.inner):
            if len(known) > self.ENTRIES:
                known.clear()
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


_ENCODERS: dict[str, CachedEncoder] = {}


def _encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path].encode_many


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def write_token_files(
    documents: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, kind: str = "byte",
    block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode and write all documents; the manifest (file, part, seq, n_docs, n_ids, first_id) is written too.

    Documents are in ascending doc_id order, null first; rows with equal ids follow
    the hash of their text. A null text is empty and has the end id alone. An empty
    table writes no file.
    """
    path = tokenizer or default_tokenizer()
    make_folder(folder)

    def run(batches):
        encode, part, writer, rows = _encoder(path), TaskContext.get().partitionId(), None, []
        system, base = resolve(folder)

        def finish():
            writer.close()
            rows[-1] |= {"n_docs": len(writer.docs), "n_ids": writer.n_ids}

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, piece in pieces(texts, PIECE_BYTES):
                for doc_id, ids in zip(ids_of[at:], encode([x.decode() for x in piece]), strict=False):
                    if writer is None or writer.n_ids >= file_ids:
                        if writer:
                            finish()
                        name = fresh_name(part, len(rows), ".ids")
                        rows.append({"file": f"{folder}/{name}", "part": part, "seq": len(rows)})
                        writer = TokenFileWriter(system.open_output_stream(f"{base}/{name}"), kind, block_ids)
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer:
            finish()
        yield pa.RecordBatch.from_pylist(rows, schema=MANIFEST)

    key, tie = F.col("doc_id").asc_nulls_first(), F.xxhash64("data")
    ordered = documents.select("doc_id", text_bytes().alias("data")).repartitionByRange(key, tie)
    written = ordered.sortWithinPartitions(key, tie).mapInArrow(
        run, "file string, part int, seq int, n_docs bigint, n_ids bigint"
    )
    counted = settle(written, "token-files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file: the only rows that one task sees together
    return settle(counted.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("bigint"))), "token-manifest")


MANIFEST = pa.schema(
    [("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files.

    A task reads whole files, a block at a time.
    """

    def run(batches):
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = resolve(file)
                with system.open_input_file(path) as source:
                    rows = list(TokenFile(source).documents())
                ids, counts, crcs = (list(x) for x in zip(*rows, strict=True))
                starts = first + np.cumsum(counts) - np.array(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    tasks = max(1, min(manifest.count(), 10_000))
    spread = manifest.select("file", "first_id").repartition(tasks)
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_report(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all documents as token files, and describe each from what was written."""
    spark: SparkSession = documents.sparkSession
    return read_token_files(write_token_files(documents, folder or new_path(spark, "token-ids")))
