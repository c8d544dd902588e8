"""Unigram and bigram TF-IDF, as a long table and as sparse vectors.

    tf-idf(doc, term) = (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), rows scaled to length 1

Vocabulary and document frequencies come from the fitting documents only.

Counting terms inside a document needs no shuffle, as a document is one row: its
terms are sorted, joined into one string, and each run of equal terms is one
pattern match. The shuffles left are one by term when fitting (after map-side
sums) and, for the long table, one by document for the row length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorSizeHint
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.stopwords import ENGLISH_STOP_WORDS
from scriptorium.schema import DEFAULTS, Settings
from scriptorium.session import settle

VOCABULARY_SCHEMA = T.StructType(
    [
        T.StructField("term_index", T.IntegerType()),
        T.StructField("term", T.StringType()),
        T.StructField("tf", T.LongType()),
        T.StructField("df", T.LongType()),
        T.StructField("idf", T.DoubleType()),
    ]
)


MAX_WORDS = 4  # times ``max_features``: so many words are looked up in each task, more are not worth it


# --- terms of one document ---------------------------------------------------


def tokenize(cleaned: Column) -> Column:
    """Tokens of two or more characters; cleaned text is ASCII. Fixed value: the class of their characters."""
    return F.regexp_extract_all(cleaned, F.lit("[a-z0-9_]{2,}"), F.lit(0))


def remove_stop_words(tokens: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs; empty for fewer than two tokens.

    Each match is one token, and what it captures reaches over the next.
    """
    return F.regexp_extract_all(F.array_join(tokens, " "), F.lit("(?=([^ ]+ [^ ]+))[^ ]++"), F.lit(1))


def with_terms(df: DataFrame, cleaned: str = "clean", stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Add ``terms``: unigrams, then bigrams, of the stop-filtered tokens."""
    inner = df.columns
    tokens = df.select(*inner, remove_stop_words(tokenize(F.col(cleaned)), stop_words).alias("_tokens"))
    return tokens.select(*inner, F.concat("_tokens", bigrams(F.col("_tokens"))).alias("terms"))


def term_counts(df: DataFrame, key: str, terms: str = "terms") -> DataFrame:
    """``key, term, tf`` for each distinct term of each document. No shuffle."""
    listed = F.array_join(F.sort_array(terms), "\n")
    runs = F.regexp_extract_all(listed, F.lit(r"(?dm)^(.++)$(?:\n\1$)*+"), F.lit(0))
    exploded = df.select(key, F.explode(runs).alias("_run"))
    term = F.substring_index("_run", "\n", 1)
    tf = (F.length("_run") + 1) / (F.length(term) + 1)
    return exploded.select(key, term.alias("term"), tf.cast("long").alias("tf"))


# --- fitting -----------------------------------------------------------------


def term_document_frequency(counts: DataFrame) -> DataFrame:
    """Corpus frequency and document frequency per term, from ``key, term, tf``."""
    return counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def frequent_terms(counts: DataFrame, n_documents: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Terms within the document-frequency limits."""
    stats = term_document_frequency(counts)
    return stats.where((F.col("df") >= settings.min_df) & (F.col("df") <= settings.max_df * n_documents))


def at_least_top(stats: DataFrame, k: int) -> DataFrame:
    """Rows that can be among the ``k`` largest ``tf``: a few times ``k`` of them.

    Terms are counted by the power of two of their ``tf``, and the rows below the
    power in which the k-th lies are dropped. The exact sort that follows then
    gets that many rows in all, not ``k`` from each of thousands of partitions.
    """
    power = F.floor(F.log2(F.col("tf").cast("double")))
    sizes = stats.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("power")).collect()
    reached = 0
    for row in sizes:
        reached += row["n"]
        if reached >= k:
            return stats.where(power >= row["power"])
    return stats


def vocabulary(counts: DataFrame, n_documents: int, settings: Settings = DEFAULTS) -> DataFrame:
    """``term, tf, df, idf`` of the most frequent terms; ties go to the smaller term.

    The frequent terms are written once, as choosing among them reads them twice.
    """
    stats = settle(frequent_terms(counts, n_documents, settings), "term-frequencies")
    top = (
        at_least_top(stats, settings.max_features)
        .orderBy(F.desc("tf"), F.asc("term"))
        .limit(settings.max_features)
    )
    idf = F.log((1.0 + F.lit(float(n_documents))) / (1.0 + F.col("df").cast("double"))) + 1.0
    return top.withColumn("idf", idf)


def words_of(df: DataFrame, key: str, cleaned: str = "clean") -> DataFrame:
    """``key, words``: the stop-filtered tokens, from which the terms are made."""
    return df.select(key, remove_stop_words(tokenize(F.col(cleaned))).alias("words"))


def leading_words(df: DataFrame, key: str, n_documents: int, settings: Settings = DEFAULTS) -> list[str] | None:
    """The words that a term of the vocabulary can hold, or None if that leaves out too little.

    If ``max_features`` words within the limits occur ``t`` times or more, no term that occurs
    less often can be chosen. A bigram occurs no more often than either of its words, so those
    of rarer words need not be counted.
    """
    counted = settle(term_document_frequency(term_counts(words_of(df, key), key, "words")), "word-frequencies")
    within = counted.where((F.col("df") >= settings.min_df) & (F.col("df") <= settings.max_df * n_documents))
    top = at_least_top(within, settings.max_features).orderBy(F.desc("tf")).limit(settings.max_features)
    reached = top.agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("t")).first()
    if reached["n"] < settings.max_features:
        return None
    rows = counted.where(F.col("tf") >= reached["t"]).select("term").limit(MAX_WORDS * settings.max_features + 1).collect()
    return [row["term"] for row in rows] if len(rows) <= MAX_WORDS * settings.max_features else None


def fit_vocabulary(df: DataFrame, key: str, settings: Settings = DEFAULTS) -> DataFrame:
    """The vocabulary of documents with a cleaned text in ``clean``.

    Words are counted first, then only the terms made of words that are frequent enough:
    most bigrams are rare, and their number grows with the corpus.
    """
    n_documents = df.count()
    words = leading_words(df, key, n_documents, settings)
    if words is None:
        return vocabulary(term_counts(with_terms(df.select(key, "clean")), key), n_documents, settings)
    # one parsed list; a word has letters, digits and underscores alone
    listed = ", ".join(f"'{w}'" for w in words)
    marked = words_of(df, key).select(key, F.expr(f"transform(words, w -> if(w IN ({listed}), w, ''))").alias("_marked"))
    # what is left out stays as a gap, so no bigram is made over it
    terms = marked.select(key, F.concat(F.array_remove("_marked", ""), bigrams(F.col("_marked"))).alias("terms"))
    return vocabulary(term_counts(terms, key), n_documents, settings)


# --- long form ---------------------------------------------------------------


def tfidf(counts: DataFrame, vocab: DataFrame, key: str, settings: Settings = DEFAULTS) -> DataFrame:
    """``key, term, weight`` with each document scaled to length 1.

    Terms outside the vocabulary drop out in the join, before the only shuffle. The
    vocabulary has ``max_features`` rows at most, so it is sent to every task: left to
    AQE, all counts are shuffled by term before its size is known.
    """
    weighted = counts.join(F.broadcast(vocab.select("term", "idf")), "term", "inner").select(
        key, "term", ((1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("weight")
    )
    return l2_normalize(weighted, key)


def l2_normalize(long: DataFrame, key: str, value: str = "weight") -> DataFrame:
    """Divide each value by the length of its document's row."""
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(key)))
    return long.withColumn(value, F.when(norm > 0, F.col(value) / norm).otherwise(F.lit(0.0)))


def combine_long(terms: DataFrame, numeric: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """``key, feature, value``: term weights and numeric features side by side."""
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    numeric_long = numeric.select(key, F.inline(F.array(*pairs)))
    term_long = terms.select(key, F.concat(F.lit("term:"), "term").alias("feature"), F.col("weight").alias("value"))
    return term_long.unionByName(numeric_long)


# --- vectors -----------------------------------------------------------------


def size_hint(column: str, size: int) -> VectorSizeHint:
    """Declare a vector's known size; assemblers need it on streams."""
    return VectorSizeHint(inputCol=column, size=size, handleInvalid="optimistic")


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary: bounded by ``max_features``, so it fits the driver."""

    terms: tuple[str, ...]
    tf: tuple[int, ...]
    df: tuple[int, ...]
    idf: tuple[float, ...]

    def transform(self, df: DataFrame, terms: str = "terms", output: str = "tfidf") -> DataFrame:
        """Add the sparse unit-length vector. Narrow: no join, no shuffle.

        Unknown terms are dropped; a document with no known term gets an
        all-zero vector.
        """
        inner = df.columns
        counted = CountVectorizerModel.from_vocabulary(
            list(self.terms), inputCol=terms, outputCol="_tf"
        ).transform(df)
        # Known terms only, so the work follows a document's terms, not the vocabulary. A
        # vector can be opened as a struct; the way back is a parse with its own type.
        opened = counted.withColumn("_open", F.unwrap_udt("_tf")).drop("_tf")
        damped = F.struct(
            F.lit(0).alias("type"), F.lit(len(self.terms)).alias("size"), F.col("_open.indices").alias("indices"),
            F.transform("_open.values", lambda x: 1.0 + F.log(x)).alias("values"),
        )
        parsed = F.from_json(F.to_json(F.struct(damped.alias("v"))), T.StructType([T.StructField("v", VectorUDT())]))
        sparse = opened.withColumn("_sparse", parsed["v"]).drop("_open")
        weighted = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_sparse", outputCol="_weighted"
        ).transform(sparse)
        scaled = Normalizer(p=2.0, inputCol="_weighted", outputCol=output).transform(weighted)
        return size_hint(output, len(self.terms)).transform(scaled).select(*inner, output)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = zip(range(len(self.terms)), self.terms, self.tf, self.df, self.idf)
        return spark.createDataFrame(list(rows), VOCABULARY_SCHEMA)

    @staticmethod
    def from_rows(rows) -> "TfidfModel":
        return TfidfModel(
            tuple(r["term"] for r in rows),
            tuple(r["tf"] for r in rows),
            tuple(r["df"] for r in rows),
            tuple(r["idf"] for r in rows),
        )

    @staticmethod
    def from_table(df: DataFrame) -> "TfidfModel":
        return TfidfModel.from_rows(df.orderBy("term_index").collect())


def fit_tfidf(train: DataFrame, key: str, settings: Settings = DEFAULTS) -> TfidfModel:
    """Fit on documents with a ``clean`` or a ``terms`` column; collects the vocabulary, and the words its terms can hold."""
    if "clean" in train.columns:
        vocab = fit_vocabulary(train, key, settings)
    else:
        vocab = vocabulary(term_counts(train, key), train.count(), settings)
    rows = vocab.collect()
    if not rows:
        raise ValueError("no term occurs in enough documents; lower min_df or add documents")
    return TfidfModel.from_rows(sorted(rows, key=lambda r: r["term"]))
