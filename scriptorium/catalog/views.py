"""Views over the given tables that stand in for metadata sources and a corpus.

Each view is one SELECT written for Spark and DuckDB alike; the two dialects
differ only in the string type and in reading a number out of an MD5. Every view but
``movies_b``, which repeats every ninth row, covers the whole table it reads; files
are missing because some rows refer to names that no document has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "conversations")


@dataclass(frozen=True)
class Dialect:
    string: str
    newline: str
    models: str

    def number_of(self, text: str) -> str:
        """First 32 bits of the MD5 of a string expression."""
        raise NotImplementedError


class SparkDialect(Dialect):
    def number_of(self, text: str) -> str:
        return f"CAST(conv(substr(md5({text}), 1, 8), 16, 10) AS BIGINT)"


class DuckDialect(Dialect):
    def number_of(self, text: str) -> str:
        return f"('0x' || substr(md5({text}), 1, 8))::bigint"


SPARK = SparkDialect("string", "char(10)", "explode(array('m1', 'm2', 'm3'))")
DUCK = DuckDialect("varchar", "chr(10)", "unnest(['m1', 'm2', 'm3'])")


def _movies_a(d: Dialect) -> str:
    text = lambda e: f"cast({e} AS {d.string})"
    h = d.number_of(f"concat({text('doc_id')}, '#r')")
    rating = f"(15 + cast(floor(least(n_chars, 4000) * 60 / 4000) AS bigint) + {h} % 18) / CAST(10 AS DOUBLE)"
    return f"""
SELECT 0 AS source_ordinal, doc_id AS row_ordinal,
  CASE WHEN doc_id % 97 = 0 THEN NULL ELSE concat('Movie ', {text('doc_id % 700')}) END AS movie_name,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE {text('1970 + doc_id % 54')} END AS year,
  CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN 'N/A' WHEN doc_id % 31 = 0 THEN '11.5'
       ELSE {text(rating)} END AS rating,
  concat('tt', {text('doc_id')}) AS imdb_id,
  CASE WHEN doc_id % 56 = 7 THEN NULL
       WHEN doc_id % 41 = 0 THEN concat('absent-', translate({text('doc_id')}, '0123456789', 'abcdefghij'))
       WHEN doc_id % 8 IN (0, 6) THEN concat('file', {text('doc_id')}, '.txt')
       WHEN doc_id % 8 IN (1, 7) THEN concat('file', {text('doc_id')})
       WHEN doc_id % 8 = 2 THEN concat('file ', {text('doc_id')})
       WHEN doc_id % 8 = 3 THEN concat(' file', {text('doc_id')}, '.txt ')
       WHEN doc_id % 8 = 4 THEN concat('FILE_', {text('doc_id')})
       ELSE concat('script-', {text('doc_id')}, '.txt') END AS script_file,
  source AS collected_by,
  CASE WHEN doc_id % 19 = 0 THEN NULL
       ELSE concat({text('cast(floor((1970 + doc_id % 54) / 10) AS bigint) * 10')}, 's') END AS decade,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN '0' WHEN doc_id % 43 = 0 THEN 'abc'
       ELSE {text(f'70 + {h} % 110')} END AS movie_length
FROM documents"""


def _movies_b(d: Dialect) -> str:
    return """
SELECT 1 AS source_ordinal, row_ordinal, movie_name, year,
  CASE WHEN rating IS NULL THEN '5.0' ELSE rating END AS rating,
  imdb_id, script_file, 'second' AS collected_by, decade, movie_length
FROM movies_a WHERE row_ordinal % 9 = 0"""


def _movies(d: Dialect) -> str:
    return "SELECT * FROM movies_a UNION ALL SELECT * FROM movies_b"


def _corpus(d: Dialect) -> str:
    n = f"cast(doc_id AS {d.string})"
    return f"""
SELECT doc_id, text,
  CASE WHEN doc_id % 10 = 6 THEN concat('file-', {n}, '.txt')
       WHEN doc_id % 10 = 7 THEN concat('file_', {n}, '.txt')
       WHEN doc_id % 10 = 8 THEN concat('file ', {n}, '.txt')
       WHEN doc_id % 10 = 9 THEN concat('file ', {n}, '.txt.txt')
       ELSE concat('file', {n}, '.txt') END AS file_name
FROM documents"""


def _texts(d: Dialect) -> str:
    """All documents, and all conversation turns dressed as short scenes."""
    s = lambda e: f"cast({e} AS {d.string})"
    return f"""
SELECT concat('d', {s('doc_id')}) AS text_id, text FROM documents
UNION ALL
SELECT concat('c', {s('conv_id')}, '-', {s('turn')}) AS text_id,
  concat(upper(role), ': ', text, {d.newline}, 'INT. ROOM ', {s('turn')}, ' - NIGHT', {d.newline},
         upper(role), ': [door ', {s('turn')}, '] Wait! (softly) It is 1', {s('turn % 10')}, ':0', {s('conv_id % 10')},
         '. Scene ', {s('conv_id')}, '?', {d.newline}, 'NARRATOR : ext. roof int the end ext.', {d.newline},
         'last words', {d.newline}, 'Note: the rest') AS text
FROM conversations"""


def _rated(d: Dialect) -> str:
    """Valid ratings of the first row per file."""
    return """
SELECT imdb_id, movie_name, script_file, year, decade, movie_length, rating, source_ordinal, row_ordinal FROM (
  SELECT imdb_id, movie_name, script_file, year, decade, movie_length, source_ordinal, row_ordinal,
         try_cast(rating AS double) AS rating,
         row_number() OVER (PARTITION BY script_file ORDER BY source_ordinal, row_ordinal) AS rn
  FROM movies) AS ranked
WHERE rn = 1 AND rating BETWEEN 0 AND 10"""


def _predictions(d: Dialect) -> str:
    """Three models with errors drawn from a hash of the key."""
    h = d.number_of("concat(imdb_id, '#', model)")
    return f"""
SELECT model, imdb_id AS script_file, movie_name, rating AS actual,
  least(CAST(10 AS DOUBLE), greatest(CAST(1 AS DOUBLE), rating + ({h} % 41 - 20) / CAST(10 AS DOUBLE))) AS predicted
FROM (SELECT rated.*, {d.models} AS model FROM rated) AS tripled"""


# name -> (definition, views it reads)
VIEWS = {
    "movies_a": (_movies_a, ()),
    "movies_b": (_movies_b, ("movies_a",)),
    "movies": (_movies, ("movies_a", "movies_b")),
    "corpus": (_corpus, ()),
    "texts": (_texts, ()),
    "rated": (_rated, ("movies",)),
    "predictions": (_predictions, ("rated",)),
}


def needed(names) -> list[str]:
    """The named views and those they read, in definition order."""
    todo, seen = list(names), set()
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            todo.extend(VIEWS[name][1])
    return [v for v in VIEWS if v in seen]


def with_clause(names, dialect: Dialect, extra=()) -> str:
    """``WITH`` clause of the named views, then of extra ``(name, sql)`` pairs."""
    parts = [(v, VIEWS[v][0](dialect)) for v in needed(names)] + list(extra)
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    sql = f"{with_clause([name], SPARK)} SELECT * FROM {name}"
    read = {t: table(spark, sf_dir, t) for t in TABLES if f"FROM {t}" in sql}
    for t in read:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **read)
