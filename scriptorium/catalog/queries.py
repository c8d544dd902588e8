"""One registered query per operator, each over whole tables.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame with stable
column names; doubles are rounded so that the SQL equivalents compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog import training_runs
from scriptorium.catalog.training_runs import SETTINGS, compared, corpus, manifest, movies, scorer, training, training_result, written_corpus, written_manifest, written_model
from scriptorium.catalog.views import table, view
from scriptorium.functions import coerce as C
from scriptorium.functions import rating as R
from scriptorium.functions import text as X
from scriptorium.operators import dedup, evaluate, gates, resolve, scale, split, stats, tfidf, weights
from scriptorium.plans import dataset as D
from scriptorium.plans import models as M
from scriptorium.plans import scoring as S
from scriptorium.plans.model_store import model_versions
from scriptorium.plans.training import predictions_of, unweighted_metrics
from scriptorium.schema import DEFAULTS, NUMERIC_FEATURES, ORDER_COLUMNS, TEXT_FEATURES
from scriptorium.session import new_path, settle
from scriptorium.sources import corpus as SC
from scriptorium.sources import manifest as SM
from scriptorium.sources import metadata as MD
from scriptorium.streaming.scoring import start_scoring

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

RAW_HEADERS = {
    "movie_name": "  Movie   name ",
    "year": "Year",
    "rating": " IMDb   Rating",
    "imdb_id": "IMDb ID ",
    "script_file": ".txt Files",
    "collected_by": "Collected  By",
    "decade": "Decaade",
    "movie_length": "Movie length",
}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _raw_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[RAW_HEADERS.get(c, c) for c in df.columns])


# --- sources and sinks -------------------------------------------------------


@query
def scan_metadata(spark, sf_dir):
    """Two CSV sources with untidy headers, and one path that does not exist."""
    base = new_path(spark, "metadata")
    for name in ("movies_a", "movies_b"):
        (
            _raw_headers(view(spark, sf_dir, name).drop("source_ordinal"))
            .write.option("header", True)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(f"{base}/{name}.csv")
        )
    paths = [f"{base}/{n}.csv" for n in ("movies_a", "movies_b", "absent")]
    return MD.read_metadata(spark, paths).drop("source_path")


@query
def scan_metadata_files(spark, sf_dir):
    """A folder of CSV files: quotes, line breaks, a repeated header, and order by file and line alone."""
    base = new_path(spark, "metadata-files")
    rows = view(spark, sf_dir, "movies_a").repartitionByRange(3, "row_ordinal").sortWithinPartitions("row_ordinal")
    named = F.concat("movie_name", F.lit(' "the, quoted"\nsecond line'))
    written = rows.select(
        named.alias(" Movie  name"), F.col("rating").alias("IMDb Rating"), F.lit("0").alias("IMDb  Rating "), F.col("imdb_id").alias("IMDb ID")
    )
    written.write.options(header=True, escape='"', quoteAll=True).csv(f"{base}/movies.csv")
    return dedup.keep_first(MD.read_metadata(spark, f"{base}/movies.csv"), ["movie_name"]).select("imdb_id", "movie_name", "rating")


@query
def normalize_headers(spark, sf_dir):
    tidy = MD.normalize_headers(_raw_headers(movies(spark, sf_dir)))
    return MD.to_engine_columns(tidy).select(*ORDER_COLUMNS, "movie_name", "rating", "decade", "script_file")


@query
def scan_corpus(spark, sf_dir):
    files = SC.read_corpus(spark, written_corpus(spark, sf_dir))
    return files.select("file_name", "n_bytes", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def decode_text(spark, sf_dir):
    """Every third document gets a byte that UTF-8 does not allow."""
    docs = table(spark, sf_dir, "documents")
    content = F.concat(F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("E9"))).otherwise(F.unhex(F.lit("0D0A"))), F.encode("text", "utf-8"))
    text = SC.decode_text(content)
    return docs.select(
        "doc_id",
        F.substring(text, 1, 1).alias("first_char"),
        F.length(text).alias("n_chars"),
        F.md5(text).alias("digest"),
    )


@query
def write_split_manifest(spark, sf_dir):
    path = new_path(spark, "manifest")
    SM.write_split_manifest(manifest(spark, sf_dir), path)
    documents = spark.read.parquet(f"{path}/documents")
    return documents.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def read_split_manifest(spark, sf_dir):
    return SM.read_split_manifest(spark, written_manifest(spark, sf_dir))


@query
def save_model(spark, sf_dir):
    path = written_model(spark, sf_dir)
    return _rounded(spark.read.parquet(f"{path}/versions/{model_versions(spark, path)[-1]}/vocabulary"), "idf")


@query
def load_model(spark, sf_dir):
    return _rounded(scorer(spark, sf_dir).featurizer.scaler.to_table(spark), "mean", "std")


# --- projections and coercions -----------------------------------------------


@query
def ensure_columns(spark, sf_dir):
    partial = view(spark, sf_dir, "movies_a").drop("collected_by", "decade")
    return MD.ensure_columns(partial).select(*ORDER_COLUMNS, "movie_name", "collected_by", "decade")


@query
def drop_duplicate_columns(spark, sf_dir):
    df = movies(spark, sf_dir).select("source_ordinal", "row_ordinal", "rating", "year", "decade")
    return MD.drop_duplicate_columns(df.toDF("source_ordinal", "row_ordinal", "rating", "rating", "decade"))


def _coerced(name, expression):
    def run(spark, sf_dir):
        return movies(spark, sf_dir).select(*ORDER_COLUMNS, expression().alias(name))

    return run


_QUERIES["coerce_rating"] = _coerced("rating", lambda: C.to_rating(F.col("rating")))
_QUERIES["coerce_year"] = _coerced("year", lambda: C.to_year(F.col("year")))
_QUERIES["coerce_decade"] = _coerced("decade", lambda: C.to_decade(F.col("decade")))
_QUERIES["coerce_length"] = _coerced("movie_length", lambda: C.to_length(F.col("movie_length")))
_QUERIES["clean_name"] = _coerced("movie_name", lambda: C.to_name(F.col("movie_name")))
_QUERIES["normalize_script_ref"] = _coerced("script_ref", lambda: C.to_script_ref(F.col("script_file")))


@query
def inference_defaults(spark, sf_dir):
    inputs = movies(spark, sf_dir).select(
        *ORDER_COLUMNS,
        F.col("year").try_cast("int").alias("year"),
        F.col("movie_length").try_cast("double").alias("movie_length"),
    )
    return D.with_scoring_defaults(inputs)


def _numeric_documents(spark, sf_dir):
    """All documents with the 19 numeric features, keyed by document id."""
    docs = D.partitioned(table(spark, sf_dir, "documents").select("doc_id", "text"), SETTINGS)
    featured = X.text_features(docs).drop("text")
    meta = view(spark, sf_dir, "movies_a").select(
        F.col("row_ordinal").alias("doc_id"),
        C.to_year(F.col("year")).alias("year"),
        C.to_decade(F.col("decade")).alias("decade"),
        C.to_length(F.col("movie_length")).alias("movie_length"),
    )
    joined = featured.join(meta, "doc_id")
    return settle(scale.encode_decades(joined, scale.decade_codes(meta)), "numeric")


@query
def feature_order(spark, sf_dir):
    """The numeric features of every document, one row each, in model order."""
    values = F.array(*(F.round(F.col(f).cast("double"), 6) for f in NUMERIC_FEATURES))
    names = F.array(*(F.lit(f) for f in NUMERIC_FEATURES))
    pairs = _numeric_documents(spark, sf_dir).select("doc_id", F.posexplode(F.arrays_zip(names.alias("f"), values.alias("v"))))
    return pairs.select("doc_id", F.col("pos").alias("position"), F.col("col.f").alias("feature"), F.col("col.v").alias("value"))


def _rated(spark, sf_dir):
    return view(spark, sf_dir, "rated")


def _predictions(spark, sf_dir):
    return view(spark, sf_dir, "predictions")


@query
def clip_prediction(spark, sf_dir):
    raw = _predictions(spark, sf_dir).select("model", "script_file", (F.col("predicted") * 2 - F.col("actual")).alias("raw"))
    clipped = R.clip_rating(F.col("raw"))
    return raw.select("model", "script_file", F.round(clipped, 2).alias("predicted_rating"))


@query
def rating_category(spark, sf_dir):
    return _rated(spark, sf_dir).select("imdb_id", "rating", R.rating_category(F.col("rating")).alias("category"))


@query
def quality_tier(spark, sf_dir):
    rating = F.col("rating")
    return _rated(spark, sf_dir).select(
        "imdb_id", R.quality_tier(rating).alias("tier"), R.quality_stars(rating).alias("stars"), R.quality_note(rating).alias("note")
    )


@query
def format_message(spark, sf_dir):
    rating = F.col("rating")
    return _rated(spark, sf_dir).select(
        "imdb_id",
        R.message(rating).alias("message"),
        R.message(rating, F.concat("imdb_id", F.lit(".txt"))).alias("file_message"),
    )


# --- gates -------------------------------------------------------------------


@query
def filter_valid_rating(spark, sf_dir):
    typed = movies(spark, sf_dir).select(*ORDER_COLUMNS, C.to_rating(F.col("rating")).alias("rating"))
    return gates.filter_valid_rating(typed)


@query
def filter_min_length(spark, sf_dir):
    kept = gates.filter_min_length(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.length("text").alias("n_chars"))


@query
def skip_reason(spark, sf_dir):
    labelled = D.label_dataset(movies(spark, sf_dir), corpus(spark, sf_dir))
    return labelled.select(*ORDER_COLUMNS, "imdb_id", "outcome")


@query
def audit_skipped(spark, sf_dir):
    listing = corpus(spark, sf_dir).select("file_name", F.octet_length("text").cast("long").alias("n_bytes"))
    return gates.audit_skipped(movies(spark, sf_dir), listing)


@query
def scoring_input_gate(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat(F.lit("s"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, F.lit(".pdf")).otherwise(F.lit(".txt"))).alias("file_name")
    )
    return named.select("doc_id", gates.scoring_error(F.col("text"), F.col("file_name")).alias("error"))


@query
def min_rows_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    enough = gates.require_documents(docs, allow_small=True)
    return docs.agg(F.count(F.lit(1)).alias("n_documents")).withColumn("enough", F.lit(enough))


@query
def path_exists(spark, sf_dir):
    refs = movies(spark, sf_dir).select(*ORDER_COLUMNS, C.to_script_ref(F.col("script_file")).alias("file_name"))
    return gates.existing_files(refs, corpus(spark, sf_dir))


# --- joins -------------------------------------------------------------------


@query
def resolve_script_files(spark, sf_dir):
    matched = resolve.resolve_script_files(movies(spark, sf_dir), corpus(spark, sf_dir).select("file_name"))
    return matched.select(*ORDER_COLUMNS, "file_name", "candidate_position")


@query
def lookup_metadata_defaults(spark, sf_dir):
    lookup = D.metadata_by_file(movies(spark, sf_dir))
    files = corpus(spark, sf_dir).select("file_name")
    return D.lookup_metadata(files, lookup, scale.decade_codes(lookup)).select("file_name", "year", "decade_encoded", "movie_length")


@query
def restrict_to_test_set(spark, sf_dir):
    sides = split.train_test_split(movies(spark, sf_dir).select(C.to_script_ref(F.col("script_file")).alias("file_name")).where("file_name is not null"), "file_name")
    return corpus(spark, sf_dir).select("file_name").join(sides.where("split = 'test'"), "file_name", "left_semi")


@query
def missing_files(spark, sf_dir):
    return gates.missing_files(movies(spark, sf_dir), corpus(spark, sf_dir).select("file_name"))


@query
def join_actual_predicted(spark, sf_dir):
    predicted = _predictions(spark, sf_dir).select("model", "script_file", "predicted")
    actual = _rated(spark, sf_dir).select(F.col("imdb_id").alias("script_file"), F.col("rating").alias("actual"))
    paired = evaluate.join_actual_predicted(actual, predicted)
    return _rounded(paired.withColumn("error", F.col("predicted") - F.col("actual")), "predicted", "error")


@query
def combine_features(spark, sf_dir):
    numeric = _numeric_documents(spark, sf_dir)
    scaled = scale.fit_scaler(numeric).transform(numeric)
    long = tfidf.combine_long(_weights(spark, sf_dir), scaled, "doc_id", NUMERIC_FEATURES)
    return long.select("doc_id", "feature", F.round("value", 5).alias("value"))


@query
def expand_duplicates(spark, sf_dir):
    rows = dedup.expand_duplicates(movies(spark, sf_dir))
    return rows.select("movie_name", "n_rows", *ORDER_COLUMNS, "script_file", "rating", "year")


# --- dedup -------------------------------------------------------------------


@query
def dedup_keep_first(spark, sf_dir):
    return dedup.keep_first(movies(spark, sf_dir))


@query
def dedup_keep_last(spark, sf_dir):
    return dedup.keep_last(movies(spark, sf_dir))


@query
def dedup_two_keys(spark, sf_dir):
    return dedup.keep_first_by_file_and_title(movies(spark, sf_dir))


@query
def duplicate_titles(spark, sf_dir):
    return dedup.duplicate_title_summary(movies(spark, sf_dir))


@query
def duplicates_ordered(spark, sf_dir):
    return dedup.duplicate_titles(movies(spark, sf_dir)).orderBy(F.desc("n_rows"), "movie_name")


@query
def duplicate_flag(spark, sf_dir):
    return dedup.duplicate_counts(movies(spark, sf_dir))


# --- aggregates --------------------------------------------------------------


@query
def rating_stats_by_source(spark, sf_dir):
    return stats.rating_stats_by_source(movies(spark, sf_dir))


@query
def rating_stats(spark, sf_dir):
    return _rounded(stats.rating_stats(_rated(spark, sf_dir)), "mean_rating", "std_rating")


@query
def load_summary(spark, sf_dir):
    return stats.load_summary(D.label_dataset(movies(spark, sf_dir), corpus(spark, sf_dir)))


@query
def range_counts(spark, sf_dir):
    return stats.range_counts(_rated(spark, sf_dir))


@query
def sample_weights(spark, sf_dir):
    weighted = weights.sample_weights(_rated(spark, sf_dir))
    return _rounded(weighted, "weight").select("imdb_id", "rating", "weight")


@query
def regression_metrics(spark, sf_dir):
    return _rounded(evaluate.regression_metrics(_predictions(spark, sf_dir)), "rmse", "mae", "r2")


@query
def error_brackets(spark, sf_dir):
    # whole tenths, so that an error on a threshold is on it in any engine
    tenths = _predictions(spark, sf_dir).withColumns({"predicted": F.round("predicted", 1) * 10, "actual": F.round("actual", 1) * 10})
    tenths = tenths.withColumns({"predicted": F.round("predicted"), "actual": F.round("actual")})
    brackets = evaluate.error_brackets(tenths, [t * 10 for t in evaluate.EVALUATION_THRESHOLDS])
    return _rounded(brackets.withColumn("threshold", F.col("threshold") / 10), "percent")


@query
def mae_by_range(spark, sf_dir):
    return _rounded(evaluate.mae_by_range(_predictions(spark, sf_dir)), "mae")


@query
def best_model(spark, sf_dir):
    metrics = evaluate.regression_metrics(_predictions(spark, sf_dir))
    return _rounded(evaluate.best_model(metrics, ["m1", "m2", "m3"]), "rmse", "mae", "r2")


@query
def scaler_stats(spark, sf_dir):
    return _rounded(scale.scaler_stats(_numeric_documents(spark, sf_dir)), "mean", "std")


@query
def decade_codes(spark, sf_dir):
    return scale.decade_codes(movies(spark, sf_dir).select(C.to_decade(F.col("decade")).alias("decade")))


@query
def term_document_frequency(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return tfidf.frequent_terms(_term_counts(spark, sf_dir), docs.count())


@query
def split_summary(spark, sf_dir):
    sides = split.train_test_split(_rated(spark, sf_dir).select("imdb_id"), "imdb_id")
    return _rounded(stats.split_summary(sides), "percent")


# --- sort, limit, sample, set operations -------------------------------------


@query
def l2_normalize(spark, sf_dir):
    """Row length of every document's TF-IDF row: 1, or no row at all."""
    squares = _weights(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("squares"), F.count(F.lit(1)).alias("n_terms"))
    return squares.select("doc_id", "n_terms", F.round(F.sqrt("squares"), 6).alias("length"))


@query
def vocabulary_topk(spark, sf_dir):
    return tfidf.fit_vocabulary(settle(_cleaned(spark, sf_dir), "cleaned"), "doc_id").select("term", "tf", "df")


@query
def sample_predictions(spark, sf_dir):
    chosen = _predictions(spark, sf_dir).where("model = 'm1'")
    return _rounded(evaluate.sample_predictions(chosen), "predicted", "error")


@query
def first_n_predictions(spark, sf_dir):
    chosen = _predictions(spark, sf_dir).where("model = 'm1'")
    return _rounded(evaluate.first_predictions(chosen), "predicted", "error")


@query
def union_sources(spark, sf_dir):
    a, b = view(spark, sf_dir, "movies_a"), view(spark, sf_dir, "movies_b").drop("collected_by")
    return MD.union_sources([a, b])


@query
def split_disjoint(spark, sf_dir):
    sides = split.train_test_split(_rated(spark, sf_dir).select("imdb_id"), "imdb_id")
    per_key = sides.groupBy("imdb_id").agg(F.count_distinct("split").alias("n_sides"))
    return per_key.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n_sides") > 1).alias("n_on_both"))


# --- text --------------------------------------------------------------------

# Masked letters let an engine whose word boundary knows only ASCII agree.
NON_ASCII_LETTERS = r"[\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"


def _mask(text):
    return F.regexp_replace(text, NON_ASCII_LETTERS, "_")


def _texts(spark, sf_dir):
    return D.partitioned(view(spark, sf_dir, "texts"), SETTINGS)


def _cleaning(step):
    def run(spark, sf_dir):
        return _texts(spark, sf_dir).select("text_id", step(F.col("text")).alias("result"))

    return run


_QUERIES["text_lower"] = _cleaning(X.text_lower)
_QUERIES["strip_brackets"] = _cleaning(X.strip_brackets)
_QUERIES["strip_parens"] = _cleaning(X.strip_parens)
_QUERIES["strip_speakers"] = _cleaning(lambda t: X.collapse_whitespace(X.strip_speakers(X.text_lower(t))))
_QUERIES["strip_timestamps"] = _cleaning(X.strip_timestamps)
_QUERIES["strip_scene_numbers"] = _cleaning(lambda t: _mask(X.strip_scene_numbers(t)))
_QUERIES["strip_int_ext"] = _cleaning(lambda t: _mask(X.strip_int_ext(t)))
_QUERIES["strip_symbols"] = _cleaning(X.strip_symbols)
_QUERIES["collapse_whitespace"] = _cleaning(X.collapse_whitespace)
_QUERIES["clean_text"] = _cleaning(X.clean_text)


def _features(spark, sf_dir):
    return X.text_features(_texts(spark, sf_dir)).drop("text")


@query
def text_features(spark, sf_dir):
    doubles = [f for f, t in _features(spark, sf_dir).dtypes if t == "double"]
    return _rounded(_features(spark, sf_dir), *doubles)


def _feature(name):
    def run(spark, sf_dir):
        df = _features(spark, sf_dir).select("text_id", name)
        return _rounded(df, name) if dict(df.dtypes)[name] == "double" else df

    return run


for _name in TEXT_FEATURES:
    _QUERIES[_name] = _feature(_name)


# --- TF-IDF, scaling, split --------------------------------------------------


def _cleaned(spark, sf_dir):
    docs = D.partitioned(table(spark, sf_dir, "documents").select("doc_id", "text"), SETTINGS)
    return docs.select("doc_id", X.clean_text(F.col("text")).alias("clean"))


def _term_counts(spark, sf_dir):
    return tfidf.term_counts(tfidf.with_terms(_cleaned(spark, sf_dir)), "doc_id")


def _weights(spark, sf_dir):
    """The cleaned text is written once: fitting and weighting both read it.

    For weighting it is dealt by document, so a row's length needs no shuffle of its terms.
    """
    cleaned = settle(_cleaned(spark, sf_dir), "cleaned")
    dealt = tfidf.term_counts(tfidf.with_terms(D.partitioned(cleaned, SETTINGS, "doc_id")), "doc_id")
    return tfidf.tfidf(dealt, tfidf.fit_vocabulary(cleaned, "doc_id"), "doc_id")


@query
def train_test_split(spark, sf_dir):
    return split.train_test_split(movies(spark, sf_dir).select("imdb_id").distinct(), "imdb_id")


@query
def exact_train_test_split(spark, sf_dir):
    return split.exact_train_test_split(movies(spark, sf_dir).select("imdb_id").distinct(), "imdb_id")


def _tokens(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("doc_id", tfidf.tokenize(F.col("clean")).alias("tokens"))


def _listed(df, column):
    return df.select("doc_id", F.size(column).alias("n"), F.array_join(column, " ").alias("listed"))


@query
def tokenize(spark, sf_dir):
    return _listed(_tokens(spark, sf_dir), F.col("tokens"))


@query
def remove_stop_words(spark, sf_dir):
    return _listed(_tokens(spark, sf_dir), tfidf.remove_stop_words(F.col("tokens")))


@query
def bigrams(spark, sf_dir):
    kept = _tokens(spark, sf_dir).select("doc_id", tfidf.remove_stop_words(F.col("tokens")).alias("tokens"))
    return _listed(kept, tfidf.bigrams(F.col("tokens")))


@query
def term_counts(spark, sf_dir):
    return _term_counts(spark, sf_dir)


@query
def tfidf_weights(spark, sf_dir):
    return _rounded(_weights(spark, sf_dir), "weight")


_QUERIES["tfidf"] = _QUERIES.pop("tfidf_weights")


@query
def tfidf_transform(spark, sf_dir):
    """Fitted on the training side, applied to the test side."""
    sides = settle(split.train_test_split(_cleaned(spark, sf_dir), "doc_id"), "cleaned", "split")
    train, test = (sides.where(F.col("split") == side) for side in ("train", "test"))
    vocab = tfidf.fit_vocabulary(train, "doc_id")
    dealt = D.partitioned(test, SETTINGS, "doc_id")
    return _rounded(tfidf.tfidf(tfidf.term_counts(tfidf.with_terms(dealt), "doc_id"), vocab, "doc_id"), "weight")


@query
def vectorize(spark, sf_dir):
    terms = tfidf.with_terms(settle(_cleaned(spark, sf_dir), "cleaned"))
    model = tfidf.fit_tfidf(terms, "doc_id")
    weights = vector_to_array("tfidf")
    return model.transform(terms).select(
        "doc_id",
        F.size(F.array_remove(weights, 0.0)).cast("long").alias("n_terms"),
        F.round(F.aggregate(weights, F.lit(0.0), lambda total, w: total + w), 5).alias("weight_sum"),
    )


@query
def standard_scale(spark, sf_dir):
    numeric = _numeric_documents(spark, sf_dir)
    scaled = scale.fit_scaler(numeric).transform(numeric)
    return scaled.select("doc_id", *(F.round(f, 5).alias(f) for f in NUMERIC_FEATURES))


# --- models and scoring ------------------------------------------------------


def _checked(scored, *columns):
    """The named columns, and whether the prediction is a rating; what SQL can state of a fitted model."""
    return scored.select(*columns, F.col("predicted_rating").between(1.0, 10.0).alias("in_range"))


def _trained(name):
    """The test side under one model, trained at full size."""

    def run(spark, sf_dir):
        predicted = compared(spark, sf_dir, name).predictions
        return predicted.select("model", "script_file", "movie_name", "actual", F.col("predicted").between(1.0, 10.0).alias("in_range"))

    return run


_QUERIES["train_random_forest"] = _trained(M.RANDOM_FOREST)
_QUERIES["train_gbt"] = _trained(M.GRADIENT_BOOSTING)
_QUERIES["train_ridge"] = _trained(M.RIDGE)
_QUERIES["train_elastic_net"] = _trained(M.ELASTIC_NET)


def _sane(df):
    """Metric rows reduced to their counts, and whether the measures fit together."""
    fits = (F.col("rmse") >= F.col("mae")) & (F.col("mae") >= 0) & (F.col("r2") <= 1)
    return df.withColumn("consistent", fits).drop("rmse", "mae", "r2")


@query
def train_and_compare(spark, sf_dir):
    """Every model's test rows, and whether the chosen one is the one with the least error."""
    result = training_result(spark, sf_dir)
    least = result.metrics.agg(F.min("rmse")).first()[0]
    chosen = (F.col("model") != result.best) | (F.col("rmse") == least)
    return _sane(result.metrics.withColumn("best_is_least", chosen))


@query
def weighted_vs_unweighted_training(spark, sf_dir):
    data = training(spark, sf_dir)
    weighted = training_result(spark, sf_dir).metrics.withColumn("weighted", F.lit(True))
    return _sane(unweighted_metrics(data, training_runs.CONFIG).unionByName(weighted))


_QUERIES["weighted_vs_unweighted"] = _QUERIES.pop("weighted_vs_unweighted_training")


@query
def load_model_predictions(spark, sf_dir):
    """Test documents, and whether the saved and reloaded model rates them as the fitted one did."""
    result, data = compared(spark, sf_dir, M.RIDGE), training(spark, sf_dir)
    again = predictions_of(scorer(spark, sf_dir).model, result.best, data.test).select("doc_key", F.col("predicted").alias("again"))
    before = result.predictions.where(F.col("model") == result.best)
    return before.join(again, "doc_key").select("doc_key", "script_file", (F.col("predicted") == F.col("again")).alias("same"))


def _corpus_inputs(spark, sf_dir):
    return D.partitioned(corpus(spark, sf_dir).select("file_name", "text"), SETTINGS)


@query
def predict_document(spark, sf_dir):
    """Every file with the year, decade code and length known for it."""
    lookup = D.metadata_by_file(movies(spark, sf_dir))
    inputs = D.lookup_metadata(_corpus_inputs(spark, sf_dir), lookup, scorer(spark, sf_dir).featurizer.decades)
    return _checked(S.predict(inputs, scorer(spark, sf_dir)), "file_name", "year", "decade_encoded", "movie_length")


@query
def predict_text(spark, sf_dir):
    """Texts without names or metadata: conversation turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return _checked(S.predict(D.partitioned(turns, SETTINGS), scorer(spark, sf_dir)), "conv_id", "turn")


@query
def batch_predict(spark, sf_dir):
    scored = S.predict(_corpus_inputs(spark, sf_dir), scorer(spark, sf_dir))
    return _checked(scored, "file_name", "year", "decade_encoded", "movie_length")


def _evaluated(spark, sf_dir):
    manifest = SM.read_split_manifest(spark, written_manifest(spark, sf_dir))
    model = scorer(spark, sf_dir)
    return S.evaluate_test_set(manifest, movies(spark, sf_dir), corpus(spark, sf_dir), model.featurizer.decades, model)


@query
def evaluate_test_set(spark, sf_dir):
    """Test rows that found their prediction, and whether the metrics follow from them."""
    reports = _evaluated(spark, sf_dir)
    error = F.col("predicted") - F.col("actual")
    own = reports["predictions"].agg(F.sqrt(F.avg(error * error)).alias("own_rmse"), F.avg(F.abs(error)).alias("own_mae")).first()
    agrees = (F.abs(F.col("rmse") - own["own_rmse"]) < 1e-9) & (F.abs(F.col("mae") - own["own_mae"]) < 1e-9)
    return reports["metrics"].select("n_rows", agrees.alias("agrees"))


@query
def prediction_analysis(spark, sf_dir):
    """Brackets and ranges of one model's predictions, as one table."""
    tenths = _predictions(spark, sf_dir).withColumns({"predicted": F.round(F.col("predicted") * 10), "actual": F.round(F.col("actual") * 10)})
    brackets = evaluate.error_brackets(tenths.where("model = 'm1'"), [t * 10 for t in evaluate.TRAINING_THRESHOLDS])
    ranges = evaluate.prediction_analysis(_predictions(spark, sf_dir), model="m1")["mae_by_range"]
    return brackets.select(
        F.lit("bracket").alias("report"), F.concat(F.lit("+/-"), (F.col("threshold") / 10).cast("string")).alias("label"), F.col("n_within").alias("n_rows"), F.round("percent", 6).alias("value")
    ).unionByName(ranges.select(F.lit("range").alias("report"), F.col("rating_range").alias("label"), "n_rows", F.round("mae", 6).alias("value")))


@query
def scoring_report(spark, sf_dir):
    report = S.scoring_report(_corpus_inputs(spark, sf_dir), scorer(spark, sf_dir))
    rating = F.col("predicted_rating")
    worded = F.col("message") == R.message(rating, F.col("file_name"))
    return report.select(
        "file_name", "error", rating.between(1.0, 10.0).alias("in_range"), (worded & (F.col("rating_category") == R.rating_category(rating))).alias("worded")
    )


@query
def scoring_stream(spark, sf_dir):
    output, checkpoint = new_path(spark, "scored"), new_path(spark, "scoring-checkpoint")
    start_scoring(spark, written_corpus(spark, sf_dir), scorer(spark, sf_dir), output, checkpoint).awaitTermination()
    streamed = spark.read.parquet(output).select("file_name", "predicted_rating", "rating_category", "message", "error")
    batch = S.scoring_report(SC.read_corpus(spark, written_corpus(spark, sf_dir)), scorer(spark, sf_dir)).select(*streamed.columns)
    # one pass over both: the batch is not scored again for each direction
    both = streamed.withColumn("_side", F.lit(1)).unionByName(batch.withColumn("_side", F.lit(-1)))
    left = both.groupBy(*streamed.columns).agg(F.abs(F.sum("_side")).alias("n"))
    differing = left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return streamed.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_differing", F.lit(differing).cast("bigint"))
