"""SQL equivalents of the registered queries, for DuckDB on the same tables.

Written from the definitions rather than from the Spark expressions, so that an
agreement means something. Of queries that depend on a fitted regressor, the SQL
states which rows they have and which conditions hold on each.
"""

from __future__ import annotations

from scriptorium.catalog.views import DUCK, with_clause
from scriptorium.plans.models import MODEL_ORDER
from scriptorium.functions.stopwords import ENGLISH_STOP_WORDS
from scriptorium.schema import NUMERIC_FEATURES, TEXT_FEATURES

# --- fixed values: character classes in RE2 spelling -------------------------
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LETTERS = r"[\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"

ORDER = "source_ordinal, row_ordinal"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _mask(e: str) -> str:
    return f"regexp_replace({e}, '{LETTERS}', '_', 'g')"


def _sub(e: str, pattern: str) -> str:
    return f"regexp_replace({e}, '{pattern}', ' ', 'g')"


BRACKETS = r"\[.*?\]"
PARENS = r"\(.*?\)"
SPEAKERS = rf"(?mi)^[A-Z][A-Z{WS}]+:"
CUES = rf"(?m)^[A-Z][A-Z{WS}]+:"
TIMES = r"\p{Nd}{1,2}:\p{Nd}{2}(:\p{Nd}{2})?"
SCENES = rf"(?i)\bscene[{WS}]*\p{{Nd}}+\b"
INT_EXT = r"(?i)\bint\.?\b|\bext\.?\b"
SYMBOLS = rf"[^a-zA-Z0-9''.,!?{WS}]"
HEADINGS = rf"(?i)\b(INT|EXT)\.?[{WS}]"


def _collapse(e: str) -> str:
    return f"trim({_sub(e, f'[{WS}]+')})"


def _clean(e: str) -> str:
    e = _sub(_sub(f"lower({e})", BRACKETS), PARENS)
    e = _mask(_sub(_sub(e, SPEAKERS), TIMES))
    e = _sub(_sub(e, SCENES), INT_EXT)
    return _collapse(_sub(e, SYMBOLS))


def _q(views, body: str, extra=()) -> str:
    if not views and not extra:
        return body
    return f"{with_clause(views, DUCK, extra)}\n{body}"


# --- shared pieces -----------------------------------------------------------

RANGE = """CASE WHEN {r} >= 1 AND {r} < 4 THEN 'Low' WHEN {r} >= 4 AND {r} < 6 THEN 'Medium'
  WHEN {r} >= 6 AND {r} < 8 THEN 'Good' WHEN {r} >= 8 AND {r} < 10 THEN 'Excellent' END"""
CATEGORY = """CASE WHEN rating >= 8 THEN 'Excellent' WHEN rating >= 7 THEN 'Good' WHEN rating >= 6 THEN 'Above Average'
  WHEN rating >= 5 THEN 'Average' WHEN rating >= 4 THEN 'Below Average' ELSE 'Poor' END"""

RATING = "try_cast(trim(rating) AS double)"
YEAR = "coalesce(try_cast(try_cast(trim(year) AS double) AS integer), 2000)"
DECADE = "coalesce(decade, '2000s')"
LENGTH = "CASE WHEN try_cast(movie_length AS double) > 0 THEN try_cast(movie_length AS double) ELSE 120.0::double END"
REF = f"CASE WHEN ends_with({_strip('script_file')}, '.txt') THEN {_strip('script_file')} ELSE {_strip('script_file')} || '.txt' END"


def _bucket(key: str) -> str:
    return f"('0x' || substr(md5({key}::varchar || '#42'), 1, 8))::bigint % 10000"


def _side(key: str) -> str:
    return f"CASE WHEN {_bucket(key)} < 3000 THEN 'test' ELSE 'train' END"


FIRST = (
    "first_rows",
    f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY script_file ORDER BY {ORDER}) AS rn FROM movies) WHERE rn = 1",
)
LAST = (
    "last_rows",
    f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY script_file ORDER BY source_ordinal DESC, row_ordinal DESC) AS rn FROM movies) WHERE rn = 1",
)
TWO_KEYS = (
    "two_keys",
    f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY movie_name ORDER BY {ORDER}) AS rn FROM first_rows) WHERE rn = 1",
)


def _candidates(source: str):
    """Candidate names of every row with their positions, and the first that exists."""
    ref, num = "ref", r"nullif(regexp_extract(ref, '(\p{Nd}+)', 1), '')"
    names = [
        ref, f"{ref} || '.txt'", f"replace({ref}, ' ', '-') || '.txt'", f"replace({ref}, ' ', '-')",
        f"replace({ref}, ' ', '_') || '.txt'", f"{ref} || '.txt.txt'", f"'file-' || {num} || '.txt'",
        f"'file_' || {num} || '.txt'", f"'file ' || {num} || '.txt'", f"'file ' || {num} || '.txt.txt'",
        f"'file' || {num} || '.txt'",
    ]
    return (
        ("refs", f"SELECT *, nullif({_strip('script_file')}, '') AS ref FROM {source}"),
        (
            "candidates",
            f"SELECT {ORDER}, unnest([{', '.join(names)}]) AS file_name, unnest(range(11)) AS position FROM refs WHERE ref IS NOT NULL",
        ),
        (
            "hits",
            f"""SELECT {ORDER}, file_name, position FROM (
              SELECT c.source_ordinal, c.row_ordinal, c.file_name, c.position,
                     row_number() OVER (PARTITION BY c.source_ordinal, c.row_ordinal ORDER BY c.position) AS rn
              FROM candidates c JOIN corpus f ON c.file_name = f.file_name) WHERE rn = 1""",
        ),
    )


OUTCOMES = (
    FIRST,
    *_candidates("first_rows"),
    (
        "outcomes",
        f"""SELECT r.source_ordinal, r.row_ordinal, r.imdb_id,
          CASE WHEN NOT coalesce({RATING} BETWEEN 0 AND 10, false) THEN 'invalid_rating'
               WHEN h.file_name IS NULL THEN 'missing'
               WHEN length(c.text) < 1000 THEN 'short' ELSE 'loaded' END AS outcome
        FROM first_rows r
        LEFT JOIN hits h ON r.source_ordinal = h.source_ordinal AND r.row_ordinal = h.row_ordinal
        LEFT JOIN corpus c ON h.file_name = c.file_name""",
    ),
)

DUPLICATES = ("dups", "SELECT movie_name, count(*) AS n_rows FROM movies WHERE movie_name IS NOT NULL GROUP BY movie_name HAVING count(*) > 1")

METRICS = """SELECT model, round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) AS rmse,
  round(avg(abs(predicted - actual)), 6) AS mae,
  round(1 - sum((predicted - actual) * (predicted - actual)) / (count(*) * var_pop(actual)), 6) AS r2,
  count(*) AS n_rows FROM predictions GROUP BY model"""


def _measured(source: str, key: str):
    """Words, sentences, cues and counts of every text, then the sixteen features."""
    words = f"regexp_extract_all(text, '[^{WS}]+')"
    sentences = f"list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '[^{WS}]'))"
    lengths = f"list_transform(sentences, lambda s: len(regexp_extract_all(s, '[^{WS}]+')))"
    return (
        (
            "parts",
            f"""SELECT {key}, text, {words} AS words, {sentences} AS sentences,
              len(string_split(text, chr(10))) AS n_lines, regexp_extract_all(text, '{CUES}') AS cues,
              len(regexp_extract_all(text, '{BRACKETS}')) + len(regexp_extract_all(text, '{PARENS}')) AS actions,
              len(regexp_extract_all({_mask('text')}, '{HEADINGS}')) AS scenes
            FROM {source}""",
        ),
        ("lengthed", f"SELECT *, len(words) AS n_words, {lengths} AS lengths FROM parts"),
        (
            "features",
            f"""SELECT {key}, length(text)::integer AS char_count, n_words::integer AS word_count, n_lines::integer AS line_count,
              coalesce(list_avg(list_transform(words, lambda w: length(w))), 0.0) AS avg_word_length,
              CASE WHEN n_words > 0 THEN len(list_distinct(words)) / n_words::double ELSE 0 END AS unique_word_ratio,
              CASE WHEN n_words > 0 THEN len(list_filter(words, lambda w: length(w) >= 8)) / n_words::double ELSE 0 END AS long_word_ratio,
              len(sentences)::integer AS sentence_count,
              coalesce(list_avg(lengths), 0.0) AS avg_sentence_length,
              coalesce(list_aggregate(lengths, 'stddev_pop'), 0.0) AS sentence_length_std,
              len(cues) / greatest(n_lines, 1)::double AS dialogue_density,
              len(list_distinct(list_transform(cues, lambda c: regexp_replace(c, '[{WS}]*:$', ''))))::integer AS unique_characters,
              (length(text) - length(replace(text, '!', ''))) / greatest(n_words, 1)::double * 100 AS exclamation_ratio,
              (length(text) - length(replace(text, '?', ''))) / greatest(n_words, 1)::double * 100 AS question_ratio,
              actions / greatest(n_words, 1)::double * 100 AS action_density,
              scenes::integer AS scene_count,
              n_words / greatest(scenes, 1)::double AS words_per_scene
            FROM lengthed""",
        ),
    )


INTEGER_FEATURES = ("char_count", "word_count", "line_count", "sentence_count", "unique_characters", "scene_count")


def _shown(feature: str) -> str:
    return feature if feature in INTEGER_FEATURES else f"round({feature}, 6) AS {feature}"


NUMERIC = (
    *_measured("documents", "doc_id"),
    ("meta", f"SELECT row_ordinal AS doc_id, {YEAR} AS year, {DECADE} AS decade, {LENGTH} AS movie_length FROM movies_a"),
    ("codes", "SELECT decade, row_number() OVER (ORDER BY decade) - 1 AS decade_encoded FROM (SELECT DISTINCT decade FROM meta)"),
    ("numeric19", "SELECT f.*, m.year, m.movie_length, c.decade_encoded FROM features f JOIN meta m USING (doc_id) JOIN codes c USING (decade)"),
    (
        "numeric_long",
        "SELECT doc_id, unnest([" + ", ".join(f"{f}::double" for f in NUMERIC_FEATURES) + "]) AS value, "
        "unnest([" + ", ".join(f"'{f}'" for f in NUMERIC_FEATURES) + "]) AS feature, "
        f"unnest(range({len(NUMERIC_FEATURES)})) AS position FROM numeric19",
    ),
    ("feature_stats", "SELECT feature, avg(value) AS mean, stddev_pop(value) AS std FROM numeric_long GROUP BY feature"),
    (
        "scaled_long",
        "SELECT l.doc_id, l.feature, (l.value - s.mean) / CASE WHEN s.std > 0 THEN s.std ELSE 1 END AS value FROM numeric_long l JOIN feature_stats s USING (feature)",
    ),
)

STOP_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + "]"


def _tokens(source: str):
    """Tokens, kept tokens, pairs and term counts of a table of ``doc_id, text``."""
    return (
        ("cleaned", f"SELECT doc_id, {_clean('text')} AS clean FROM {source}"),
        ("tokens", "SELECT doc_id, regexp_extract_all(clean, '[a-z0-9_]{2,}') AS tokens FROM cleaned"),
        ("kept", f"SELECT doc_id, list_filter(tokens, lambda t: NOT list_contains({STOP_LIST}, t)) AS tokens FROM tokens"),
        (
            "pairs",
            "SELECT doc_id, tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]) AS pairs FROM kept",
        ),
        ("occurrences", "SELECT doc_id, unnest(list_concat(tokens, pairs)) AS term FROM pairs"),
        ("counts", "SELECT doc_id, term, count(*) AS tf FROM occurrences GROUP BY doc_id, term"),
    )


TOKENS = _tokens("documents")


def _fit(counts: str, n_documents: str):
    """Vocabulary with inverse document frequencies, fitted on a count table."""
    return (
        ("sizes", f"SELECT ({n_documents})::double AS n"),
        (
            "frequencies",
            f"SELECT term, sum(tf)::bigint AS tf, count(*) AS df FROM {counts} GROUP BY term "
            "HAVING count(*) >= 3 AND count(*) <= 0.85::double * (SELECT n FROM sizes)",
        ),
        (
            "vocab",
            "SELECT term, tf, df, ln((1 + (SELECT n FROM sizes)) / (1 + df::double)) + 1 AS idf FROM frequencies ORDER BY tf DESC, term LIMIT 8000",
        ),
    )


def _weigh(counts: str):
    return (
        ("raw_weights", f"SELECT doc_id, term, (1 + ln(c.tf::double)) * idf AS w FROM {counts} c JOIN vocab USING (term)"),
        ("weights", "SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw_weights"),
    )


TFIDF = (*TOKENS, *_fit("counts", "SELECT count(*) FROM documents"), *_weigh("counts"))

SPLIT_TFIDF = (
    *TOKENS,
    ("train_counts", f"SELECT * FROM counts WHERE {_side('doc_id')} = 'train'"),
    ("test_counts", f"SELECT * FROM counts WHERE {_side('doc_id')} = 'test'"),
    *_fit("train_counts", f"SELECT count(*) FROM documents WHERE {_side('doc_id')} = 'train'"),
    *_weigh("test_counts"),
)

LOADED = (
    *OUTCOMES,
    (
        "loaded",
        f"""SELECT r.source_ordinal || ':' || r.row_ordinal AS doc_id, h.file_name, c.text, {_side('h.file_name')} AS split,
          coalesce({_strip('r.movie_name')}, 'Unknown') AS movie_name, try_cast(trim(r.rating) AS double) AS rating,
          {YEAR} AS year, {DECADE} AS decade, {LENGTH} AS movie_length
        FROM outcomes o
        JOIN first_rows r ON o.source_ordinal = r.source_ordinal AND o.row_ordinal = r.row_ordinal
        JOIN hits h ON o.source_ordinal = h.source_ordinal AND o.row_ordinal = h.row_ordinal
        JOIN corpus c ON h.file_name = c.file_name WHERE outcome = 'loaded'""",
    ),
    ("training_rows", "SELECT * FROM loaded WHERE split = 'train'"),
)
TRAINED_VOCABULARY = (*LOADED, *_tokens("training_rows"), *_fit("counts", "SELECT count(*) FROM training_rows"))
TRAINED_SCALER = (
    *LOADED,
    *_measured("training_rows", "doc_id"),
    ("codes", "SELECT decade, row_number() OVER (ORDER BY decade) - 1 AS decade_encoded FROM (SELECT DISTINCT decade FROM loaded)"),
    ("numeric19", "SELECT f.*, m.year, m.movie_length, c.decade_encoded FROM features f JOIN training_rows m USING (doc_id) JOIN codes c USING (decade)"),
    NUMERIC[-3],
    NUMERIC[-2],
)

LOOKUP = (
    (
        "lookup",
        f"""SELECT file_name, {YEAR} AS year, {DECADE} AS decade, {LENGTH} AS movie_length FROM (
          SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY source_ordinal DESC, row_ordinal DESC) AS rn
          FROM (SELECT *, {REF} AS file_name FROM movies) WHERE file_name IS NOT NULL) WHERE rn = 1""",
    ),
    ("codes", "SELECT decade, row_number() OVER (ORDER BY decade) - 1 AS decade_encoded FROM (SELECT DISTINCT decade FROM lookup)"),
)

ALL = "SELECT source_ordinal, row_ordinal, movie_name, year, rating, imdb_id, script_file, collected_by, decade, movie_length FROM"


def _cleaning(expression: str) -> str:
    return _q(["texts"], f"SELECT text_id, {expression} AS result FROM texts")


def _column(name: str, expression: str) -> str:
    return _q(["movies"], f"SELECT {ORDER}, {expression} AS {name} FROM movies")


def _brackets(thresholds, where: str = "") -> str:
    values = ", ".join(str(round(t * 10)) for t in thresholds)
    return f"""SELECT model, count(*) AS n_rows, t / 10.0::double AS threshold,
      count(*) FILTER (abs(round(predicted * 10) - round(actual * 10)) <= t) AS n_within
      FROM predictions, (SELECT unnest([{values}]) AS t) {where} GROUP BY model, t"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "scan_metadata": _q(["movies"], f"{ALL} movies"),
        "scan_metadata_files": _q(
            ["movies_a"],
            """SELECT imdb_id, movie_name || ' "the, quoted"' || chr(10) || 'second line' AS movie_name, rating FROM (
              SELECT *, row_number() OVER (PARTITION BY movie_name ORDER BY row_ordinal) AS rn FROM movies_a) WHERE rn = 1""",
        ),
        "normalize_headers": _q(["movies"], f"SELECT {ORDER}, movie_name, rating, decade, script_file FROM movies"),
        "scan_corpus": _q(["corpus"], "SELECT file_name, strlen(text) AS n_bytes, length(text)::integer AS n_chars, md5(text) AS digest FROM corpus"),
        "decode_text": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'é' ELSE chr(10) END AS first_char,
            (CASE WHEN doc_id % 3 = 0 THEN strlen(text) + 1 ELSE length(text) + 1 END)::integer AS n_chars,
            CASE WHEN doc_id % 3 <> 0 THEN md5(chr(10) || text) ELSE md5('é' || array_to_string(list_transform(
              regexp_extract_all(hex(encode(text)), '..'), lambda x: chr(('0x' || x)::integer)), '')) END AS digest FROM documents""",
        "write_split_manifest": _q(["movies", "corpus"], "SELECT split, count(*) AS n_rows FROM loaded GROUP BY split", LOADED),
        "read_split_manifest": _q(
            ["movies", "corpus"], "SELECT file_name AS script_file, movie_name, rating, split FROM loaded", LOADED
        ),
        "save_model": _q(
            ["movies", "corpus"],
            "SELECT (row_number() OVER (ORDER BY term) - 1)::integer AS term_index, term, tf, df, round(idf, 6) AS idf FROM vocab",
            TRAINED_VOCABULARY,
        ),
        "load_model": _q(
            ["movies", "corpus"],
            "SELECT DISTINCT position::integer AS position, feature, round(mean, 6) AS mean, round(std, 6) AS std FROM feature_stats JOIN numeric_long USING (feature)",
            TRAINED_SCALER,
        ),
        "ensure_columns": _q(["movies_a"], f"SELECT {ORDER}, movie_name, NULL::varchar AS collected_by, NULL::varchar AS decade FROM movies_a"),
        "drop_duplicate_columns": _q(["movies"], f"SELECT {ORDER}, rating, decade FROM movies"),
        "coerce_rating": _column("rating", RATING),
        "coerce_year": _column("year", YEAR),
        "coerce_decade": _column("decade", DECADE),
        "coerce_length": _column("movie_length", LENGTH),
        "clean_name": _column("movie_name", "coalesce(trim(movie_name), 'Unknown')"),
        "normalize_script_ref": _column("script_ref", REF),
        "inference_defaults": _q(
            ["movies"],
            f"""SELECT {ORDER}, coalesce(try_cast(year AS integer), 2020) AS year,
            coalesce(try_cast(movie_length AS double), 120) AS movie_length, 0 AS decade_encoded FROM movies""",
        ),
        "feature_order": _q(["movies_a"], "SELECT doc_id, position::integer AS position, feature, round(value, 6) AS value FROM numeric_long", NUMERIC),
        "clip_prediction": _q(
            ["predictions"],
            """SELECT model, script_file, round(least(greatest(predicted * 2 - actual, 1), 10), 2) AS predicted_rating FROM predictions""",
        ),
        "rating_category": _q(["rated"], f"SELECT imdb_id, rating, {CATEGORY} AS category FROM rated"),
        "quality_tier": _q(
            ["rated"],
            """SELECT imdb_id,
            CASE WHEN rating >= 8 THEN 'Excellent' WHEN rating >= 6.5 THEN 'Good' WHEN rating >= 5 THEN 'Average'
                 WHEN rating >= 3.5 THEN 'Below Average' ELSE 'Poor' END AS tier,
            CASE WHEN rating >= 8 THEN '*****' WHEN rating >= 6.5 THEN '****' WHEN rating >= 5 THEN '***'
                 WHEN rating >= 3.5 THEN '**' ELSE '*' END AS stars,
            CASE WHEN rating >= 8 THEN 'This script shows strong potential for critical acclaim.'
                 WHEN rating >= 6.5 THEN 'This script has good commercial potential.'
                 WHEN rating >= 5 THEN 'This script may need some improvements.'
                 ELSE 'This script likely needs significant revision.' END AS note FROM rated""",
        ),
        "format_message": _q(
            ["rated"],
            f"""SELECT imdb_id, 'Predicted rating: ' || rating::varchar || '/10 (' || ({CATEGORY}) || ')' AS message,
            'Predicted rating for ''' || imdb_id || '.txt'': ' || rating::varchar || '/10 (' || ({CATEGORY}) || ')' AS file_message FROM rated""",
        ),
        "filter_valid_rating": _q(["movies"], f"SELECT * FROM (SELECT {ORDER}, {RATING} AS rating FROM movies) WHERE rating BETWEEN 0 AND 10"),
        "filter_min_length": "SELECT doc_id, length(text)::integer AS n_chars FROM documents WHERE length(text) >= 1000",
        "skip_reason": _q(["movies", "corpus"], "SELECT * FROM outcomes", OUTCOMES),
        "audit_skipped": _q(
            ["movies", "corpus"],
            f"""SELECT {ORDER}, movie_name, reason,
              CASE reason WHEN 'invalid_rating' THEN 'rating=' || coalesce(rating, 'none') WHEN 'missing' THEN ref
                   ELSE ref || ' (' || n_bytes::varchar || ' bytes)' END AS detail
            FROM (SELECT m.*, strlen(c.text) AS n_bytes,
                    CASE WHEN NOT coalesce({RATING} BETWEEN 0 AND 10, false) THEN 'invalid_rating'
                         WHEN c.file_name IS NULL THEN 'missing' WHEN strlen(c.text) < 1000 THEN 'too_short' END AS reason
                  FROM (SELECT *, coalesce({REF}, '.txt') AS ref FROM two_keys) m LEFT JOIN corpus c ON m.ref = c.file_name)
            WHERE reason IS NOT NULL""",
            (FIRST, TWO_KEYS),
        ),
        "scoring_input_gate": f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'only .txt files are supported'
            WHEN length({_strip('text')}) < 100 THEN 'text is too short' END AS error FROM documents""",
        "min_rows_gate": "SELECT count(*) AS n_documents, count(*) >= 100 AS enough FROM documents",
        "path_exists": _q(["movies", "corpus"], f"SELECT {ORDER}, file_name FROM (SELECT *, {REF} AS file_name FROM movies) WHERE file_name IN (SELECT file_name FROM corpus)"),
        "resolve_script_files": _q(
            ["movies", "corpus"],
            """SELECT m.source_ordinal, m.row_ordinal, h.file_name, h.position::integer AS candidate_position
            FROM movies m LEFT JOIN hits h ON m.source_ordinal = h.source_ordinal AND m.row_ordinal = h.row_ordinal""",
            _candidates("movies"),
        ),
        "lookup_metadata_defaults": _q(
            ["movies", "corpus"],
            """SELECT f.file_name, coalesce(l.year, 2020) AS year, coalesce(c.decade_encoded, 0)::integer AS decade_encoded,
            coalesce(l.movie_length, 120) AS movie_length
            FROM corpus f LEFT JOIN lookup l ON f.file_name = l.file_name LEFT JOIN codes c ON l.decade = c.decade""",
            LOOKUP,
        ),
        "restrict_to_test_set": _q(
            ["movies", "corpus"],
            f"SELECT file_name FROM corpus WHERE file_name IN (SELECT file_name FROM (SELECT {REF} AS file_name FROM movies) WHERE {_side('file_name')} = 'test')",
        ),
        "missing_files": _q(
            ["movies", "corpus"],
            f"""SELECT file_name, {ORDER}, movie_name FROM (SELECT *, {REF} AS file_name FROM movies)
            WHERE file_name IS NOT NULL AND file_name NOT IN (SELECT file_name FROM corpus)""",
        ),
        "join_actual_predicted": _q(
            ["predictions"],
            """SELECT script_file, actual, model, round(predicted, 6) AS predicted, round(predicted - actual, 6) AS error FROM predictions""",
        ),
        "combine_features": _q(
            ["movies_a"],
            """SELECT doc_id, 'term:' || term AS feature, round(weight, 5) AS value FROM weights
            UNION ALL SELECT doc_id, feature, round(value, 5) FROM scaled_long""",
            (*NUMERIC, *TFIDF),
        ),
        "expand_duplicates": _q(
            ["movies"], f"SELECT movie_name, n_rows, {ORDER}, script_file, rating, year FROM movies JOIN dups USING (movie_name)", (DUPLICATES,)
        ),
        "dedup_keep_first": _q(["movies"], f"{ALL} first_rows", (FIRST,)),
        "dedup_keep_last": _q(["movies"], f"{ALL} last_rows", (LAST,)),
        "dedup_two_keys": _q(["movies"], f"{ALL} two_keys", (FIRST, TWO_KEYS)),
        "duplicate_titles": _q(
            ["movies"], "SELECT count(*) AS names, sum(n_rows)::bigint AS total_rows, sum(n_rows - 1)::bigint AS extra_rows FROM dups", (DUPLICATES,)
        ),
        "duplicates_ordered": _q(["movies"], "SELECT movie_name, n_rows FROM dups ORDER BY n_rows DESC, movie_name", (DUPLICATES,)),
        "duplicate_flag": _q(
            ["movies"],
            """SELECT count(*) AS total_rows, count(*) FILTER (rn = 1) AS kept_rows, count(*) FILTER (rn > 1) AS duplicate_rows
            FROM (SELECT row_number() OVER (PARTITION BY script_file) AS rn FROM movies)""",
        ),
        "rating_stats_by_source": _q(
            ["movies"],
            f"SELECT source_ordinal, count(*) AS n_rows, count({RATING}) AS n_ratings, min({RATING}) AS min_rating, max({RATING}) AS max_rating FROM movies GROUP BY source_ordinal",
        ),
        "rating_stats": _q(
            ["rated"],
            "SELECT count(rating) AS n_ratings, min(rating) AS min_rating, max(rating) AS max_rating, round(avg(rating), 6) AS mean_rating, round(stddev_pop(rating), 6) AS std_rating FROM rated",
        ),
        "load_summary": _q(
            ["movies", "corpus"],
            "SELECT outcome, count(*) AS n_rows FROM outcomes GROUP BY outcome UNION ALL SELECT 'total', count(*) FROM outcomes",
            OUTCOMES,
        ),
        "range_counts": _q(
            ["rated"],
            f"SELECT * FROM (SELECT {RANGE.format(r='rating')} AS rating_range, count(*) AS n_rows FROM rated GROUP BY 1) WHERE rating_range IS NOT NULL",
        ),
        "sample_weights": _q(
            ["rated"],
            """SELECT imdb_id, rating, round(coalesce((SELECT max(n) FROM per_range) / per_range.n::double, 1.0), 6) AS weight
            FROM ranged LEFT JOIN per_range USING (rating_range)""",
            (
                ("ranged", f"SELECT *, {RANGE.format(r='rating')} AS rating_range FROM rated"),
                ("per_range", "SELECT rating_range, count(*) AS n FROM ranged WHERE rating_range IS NOT NULL GROUP BY rating_range"),
            ),
        ),
        "regression_metrics": _q(["predictions"], METRICS),
        "error_brackets": _q(
            ["predictions"],
            f"SELECT model, threshold, n_within, round(n_within * 100.0::double / n_rows, 6) AS percent FROM ({_brackets((0.5, 1.0, 1.5, 2.0, 2.5, 3.0))})",
        ),
        "mae_by_range": _q(
            ["predictions"],
            f"""SELECT * FROM (SELECT model, {RANGE.format(r='actual')} AS rating_range, round(avg(abs(predicted - actual)), 6) AS mae,
            count(*) AS n_rows FROM predictions GROUP BY 1, 2) WHERE rating_range IS NOT NULL""",
        ),
        "best_model": _q(["predictions"], f"SELECT * FROM ({METRICS}) ORDER BY rmse, model LIMIT 1"),
        "scaler_stats": _q(["movies_a"], "SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM feature_stats", NUMERIC),
        "decade_codes": _q(
            ["movies"],
            f"SELECT decade, (row_number() OVER (ORDER BY decade) - 1)::integer AS decade_encoded FROM (SELECT DISTINCT {DECADE} AS decade FROM movies)",
        ),
        "term_document_frequency": _q([], "SELECT term, tf, df FROM frequencies", (*TOKENS, *_fit("counts", "SELECT count(*) FROM documents"))),
        "split_summary": _q(
            ["rated"],
            f"""SELECT split, n_rows, round(n_rows * 100.0::double / sum(n_rows) OVER (), 6) AS percent
            FROM (SELECT {_side('imdb_id')} AS split, count(*) AS n_rows FROM rated GROUP BY 1)""",
        ),
        "l2_normalize": _q([], "SELECT doc_id, count(*) AS n_terms, round(sqrt(sum(weight * weight)), 6) AS length FROM weights GROUP BY doc_id", TFIDF),
        "vocabulary_topk": _q([], "SELECT term, tf, df FROM vocab", (*TOKENS, *_fit("counts", "SELECT count(*) FROM documents"))),
        "sample_predictions": _q(
            ["predictions"],
            """SELECT script_file, actual, round(predicted, 6) AS predicted, round(predicted - actual, 6) AS error
            FROM predictions WHERE model = 'm1' ORDER BY md5(script_file || '#42'), script_file LIMIT 15""",
        ),
        "first_n_predictions": _q(
            ["predictions"],
            """SELECT script_file, left(coalesce(movie_name, 'Unknown'), 28) AS movie_name, actual, round(predicted, 6) AS predicted,
            round(abs(predicted - actual), 6) AS error FROM predictions WHERE model = 'm1' ORDER BY script_file LIMIT 20""",
        ),
        "union_sources": _q(
            ["movies"],
            f"SELECT {ORDER}, movie_name, year, rating, imdb_id, script_file, CASE WHEN source_ordinal = 0 THEN collected_by END AS collected_by, decade, movie_length FROM movies",
        ),
        "split_disjoint": _q(["rated"], "SELECT count(DISTINCT imdb_id) AS n_keys, 0::bigint AS n_on_both FROM rated"),
        "text_lower": _cleaning("lower(text)"),
        "strip_brackets": _cleaning(_sub("text", BRACKETS)),
        "strip_parens": _cleaning(_sub("text", PARENS)),
        "strip_speakers": _cleaning(_collapse(_sub("lower(text)", SPEAKERS))),
        "strip_timestamps": _cleaning(_sub("text", TIMES)),
        "strip_scene_numbers": _cleaning(_sub(_mask("text"), SCENES)),
        "strip_int_ext": _cleaning(_sub(_mask("text"), INT_EXT)),
        "strip_symbols": _cleaning(_sub("text", SYMBOLS)),
        "collapse_whitespace": _cleaning(_collapse("text")),
        "clean_text": _cleaning(_clean("text")),
        "text_features": _q(["texts"], f"SELECT text_id, {', '.join(_shown(f) for f in TEXT_FEATURES)} FROM features", _measured("texts", "text_id")),
        "train_test_split": _q(["movies"], f"SELECT imdb_id, {_side('imdb_id')} AS split FROM (SELECT DISTINCT imdb_id FROM movies)"),
        "exact_train_test_split": _q(
            ["movies"],
            """SELECT imdb_id, CASE WHEN row_number() OVER (ORDER BY md5(imdb_id || '#42')) <= ceil(0.3 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
            FROM (SELECT DISTINCT imdb_id FROM movies)""",
        ),
        "tokenize": _q([], "SELECT doc_id, len(tokens)::integer AS n, array_to_string(tokens, ' ') AS listed FROM tokens", TOKENS),
        "remove_stop_words": _q([], "SELECT doc_id, len(tokens)::integer AS n, array_to_string(tokens, ' ') AS listed FROM kept", TOKENS),
        "bigrams": _q([], "SELECT doc_id, len(pairs)::integer AS n, array_to_string(pairs, ' ') AS listed FROM pairs", TOKENS),
        "term_counts": _q([], "SELECT doc_id, term, tf FROM counts", TOKENS),
        "tfidf": _q([], "SELECT doc_id, term, round(weight, 6) AS weight FROM weights", TFIDF),
        "tfidf_transform": _q([], "SELECT doc_id, term, round(weight, 6) AS weight FROM weights", SPLIT_TFIDF),
        "vectorize": _q(
            [],
            """SELECT d.doc_id, count(w.term) AS n_terms, round(coalesce(sum(weight), 0), 5) AS weight_sum
            FROM documents d LEFT JOIN weights w ON d.doc_id = w.doc_id GROUP BY d.doc_id""",
            TFIDF,
        ),
        "standard_scale": _q(
            ["movies_a"],
            "SELECT doc_id, " + ", ".join(f"round(max(value) FILTER (feature = '{f}'), 5) AS {f}" for f in NUMERIC_FEATURES) + " FROM scaled_long GROUP BY doc_id",
            NUMERIC,
        ),
        "prediction_analysis": _q(
            ["predictions"],
            f"""SELECT 'bracket' AS report, '+/-' || threshold::varchar AS label, n_within AS n_rows, round(n_within * 100.0::double / n_rows, 6) AS value
            FROM ({_brackets((0.5, 1.0, 1.5, 2.0), "WHERE model = 'm1'")})
            UNION ALL SELECT 'range', rating_range, n_rows, mae FROM (
              SELECT {RANGE.format(r='actual')} AS rating_range, round(avg(abs(predicted - actual)), 6) AS mae, count(*) AS n_rows
              FROM predictions WHERE model = 'm1' GROUP BY 1) WHERE rating_range IS NOT NULL""",
        ),
    }
    test = "FROM loaded WHERE split = 'test'"
    for name, query in zip(MODEL_ORDER, ("train_random_forest", "train_gbt", "train_ridge", "train_elastic_net"), strict=True):
        sql[query] = _q(
            ["movies", "corpus"], f"SELECT '{name}' AS model, file_name AS script_file, movie_name, rating AS actual, true AS in_range {test}", LOADED
        )
    models = "(SELECT unnest([" + ", ".join(f"'{m}'" for m in MODEL_ORDER) + "]) AS model)"
    sql["train_and_compare"] = _q(
        ["movies", "corpus"], f"SELECT model, n_rows, true AS best_is_least, true AS consistent FROM {models}, (SELECT count(*) AS n_rows {test})", LOADED
    )
    sql["weighted_vs_unweighted"] = _q(
        ["movies", "corpus"],
        f"SELECT model, weighted, n_rows, true AS consistent FROM {models}, (SELECT unnest([false, true]) AS weighted), (SELECT count(*) AS n_rows {test})",
        LOADED,
    )
    sql["load_model_predictions"] = _q(["movies", "corpus"], f"SELECT doc_id AS doc_key, file_name AS script_file, true AS same {test}", LOADED)
    sql["evaluate_test_set"] = _q(["movies", "corpus"], f"SELECT count(*) AS n_rows, true AS agrees {test}", LOADED)
    sql["predict_document"] = _q(
        ["movies", "corpus"],
        """SELECT f.file_name, coalesce(l.year, 2020) AS year, coalesce(c.decade_encoded, 0)::integer AS decade_encoded,
        coalesce(l.movie_length, 120) AS movie_length, true AS in_range
        FROM corpus f LEFT JOIN lookup l ON f.file_name = l.file_name LEFT JOIN fitted c ON l.decade = c.decade""",
        (
            *LOADED,
            LOOKUP[0],
            ("fitted", "SELECT decade, row_number() OVER (ORDER BY decade) - 1 AS decade_encoded FROM (SELECT DISTINCT decade FROM loaded)"),
        ),
    )
    sql["batch_predict"] = _q(
        ["corpus"], "SELECT file_name, 2020 AS year, 0 AS decade_encoded, 120.0::double AS movie_length, true AS in_range FROM corpus"
    )
    sql["predict_text"] = "SELECT conv_id, turn, true AS in_range FROM conversations"
    short = f"length({_strip('text')}) < 100"
    sql["scoring_report"] = _q(
        ["corpus"],
        f"""SELECT file_name, CASE WHEN {short} THEN 'text is too short' END AS error,
        CASE WHEN NOT {short} THEN true END AS in_range, CASE WHEN NOT {short} THEN true END AS worded FROM corpus""",
    )
    sql["scoring_stream"] = _q(["corpus"], "SELECT count(*) AS n_rows, 0::bigint AS n_differing FROM corpus")
    for feature in TEXT_FEATURES:
        sql[feature] = _q(["texts"], f"SELECT text_id, {_shown(feature)} FROM features", _measured("texts", "text_id"))
    return sql
