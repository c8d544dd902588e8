import pytest
from pyspark.sql import functions as F

from scriptorium.functions import coerce as C
from scriptorium.functions import rating as R
from scriptorium.schema import EXPECTED_COLUMNS
from scriptorium.sources import metadata as MD


def values(spark, rows, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_rating_strings(spark):
    rows = [" 7.5 ", "abc", None, "NaN", "-0.1", "10.1", "0", "10", "7.5d"]
    assert values(spark, rows, "string", C.to_rating) == [7.5, None, None, None, -0.1, 10.1, 0.0, 10.0, None]
    valid = values(spark, rows, "string", lambda c: C.is_valid_rating(C.to_rating(c)))
    assert valid == [True, False, False, False, False, False, True, True, False]


def test_other_coercions(spark):
    assert values(spark, ["1994", "1994.0", "x", None], "string", C.to_year) == [1994, 1994, 2000, 2000]
    assert values(spark, ["90", "0", "-5", "abc", None, "NaN"], "string", C.to_length) == [90.0, 120.0, 120.0, 120.0, 120.0, 120.0]
    assert values(spark, [" a ", None, "b.txt"], "string", C.to_script_ref) == ["a.txt", None, "b.txt"]
    assert values(spark, [" Up ", None], "string", C.to_name) == ["Up", "Unknown"]


def test_scales(spark):
    assert values(spark, [8.0, 7.0, 6.0, 5.0, 4.0, 3.99], "double", R.rating_category) == [
        "Excellent", "Good", "Above Average", "Average", "Below Average", "Poor"]
    assert values(spark, [8.0, 6.5, 5.0, 3.5, 3.49], "double", R.quality_tier) == [
        "Excellent", "Good", "Average", "Below Average", "Poor"]
    assert values(spark, [8.0, 3.0], "double", R.quality_stars) == ["*****", "*"]
    assert values(spark, [0.5, 1.0, 3.999, 4.0, 6.0, 8.0, 10.0], "double", R.rating_range) == [
        None, "Low", "Low", "Medium", "Good", "Excellent", None]
    assert values(spark, [-3.0, 5.5, 12.0], "double", R.clip_rating) == [1.0, 5.5, 10.0]
    assert values(spark, [7.25], "double", R.message) == ["Predicted rating: 7.25/10 (Good)"]
    assert values(spark, [7.25], "double", lambda c: R.message(c, F.lit("a.txt"))) == ["Predicted rating for 'a.txt': 7.25/10 (Good)"]


def test_headers():
    assert MD.tidy_header("  IMDb   Rating ") == "IMDb Rating"
    assert MD.tidy_header("Decaade") == "Decade"


def test_duplicate_columns_keep_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b", "c"]).toDF(" a", "a ", "b")
    out = MD.drop_duplicate_columns(MD.normalize_headers(df))
    assert out.columns == ["a", "b"] and out.first()["a"] == 1


def test_chosen_paths():
    assert MD.chosen_paths("x.csv", "f") == ["x.csv"]
    assert MD.chosen_paths(["x", "y"], "f") == ["x", "y"]
    assert MD.chosen_paths([], "f") == MD.chosen_paths(None, "f") == MD.chosen_paths("", "f") == ["f"]


def test_read_metadata_from_csv(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("Movie name ,Year,IMDb  Rating,.txt Files,Decaade\nUp,2009,8.3, file1.txt ,2000s\nOld,,,x,\n")
    b.write_text("Movie name,IMDb Rating,.txt Files,Movie length,Extra\nUp,8.0,file1.txt,96,e\n")
    df = MD.read_metadata(spark, [str(a), str(tmp_path / "none.csv"), str(b)])
    assert set(EXPECTED_COLUMNS) <= set(df.columns) and "Extra" in df.columns
    rows = df.orderBy("source_ordinal", "row_ordinal").collect()
    assert [(r.source_ordinal, r.row_ordinal, r.movie_name, r.decade) for r in rows] == [
        (0, 0, "Up", "2000s"), (0, 1, "Old", None), (2, 0, "Up", None)]
    assert rows[0].script_file == " file1.txt " and rows[1].rating is None and rows[2].movie_length == "96"
    with pytest.raises(FileNotFoundError):
        MD.read_metadata(spark, [str(tmp_path / "none.csv")])


def test_repeated_header_keeps_the_first_column(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("Movie name,IMDb Rating,IMDb Rating,.txt Files\nUp,8.3,1.0,a\n")
    row = MD.read_metadata(spark, str(path)).first()
    assert (row.rating, row.script_file) == ("8.3", "a")


def test_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('Movie name,Year,.txt Files\n"He said ""hi, you"" loud",1999,a\n"two\nlines",2000,b\n')
    rows = MD.read_metadata(spark, str(path)).orderBy("row_ordinal").collect()
    assert [(r.movie_name, r.year, r.script_file) for r in rows] == [('He said "hi, you" loud', "1999", "a"), ("two\nlines", "2000", "b")]


def test_typed_and_text_sources_meet(spark, tmp_path):
    typed, text = str(tmp_path / "t.parquet"), tmp_path / "a.csv"
    spark.createDataFrame([("Up", 2009)], "`Movie name` string, Year int").write.parquet(typed)
    text.write_text("Movie name,Year\nOld,N/A\n")
    rows = MD.read_metadata(spark, [typed, str(text)]).orderBy("source_ordinal").collect()
    assert [r.year for r in rows] == ["2009", "N/A"]


def test_order_follows_files_not_sizes(spark, tmp_path):
    folder = tmp_path / "m.csv"
    folder.mkdir()
    at = 0
    for k, n in enumerate((1, 4, 7)):
        (folder / f"part-{k}.csv").write_text("IMDb ID,Movie name\n" + "".join(f"{at + i},{'x' * 50 * k}\n" for i in range(n)))
        at += n
    packed = str(tmp_path / "m.parquet")
    rows = [r.imdb_id for r in MD.read_metadata(spark, str(folder)).orderBy("row_ordinal").collect()]
    assert rows == [str(i) for i in range(12)]
    spark.createDataFrame([(str(i),) for i in range(40)], "`IMDb ID` string").repartitionByRange(3, "`IMDb ID`").write.parquet(packed)
    first = MD.read_metadata(spark, packed).orderBy("row_ordinal").collect()
    assert sorted(r.imdb_id for r in first) == sorted(str(i) for i in range(40)) and len({r.row_ordinal for r in first}) == 40


def test_unreadable_sources_are_skipped(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"not parquet at all")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "ok.csv").write_text("Movie name\nUp\n")
    paths = [str(tmp_path / n) for n in ("bad.parquet", "empty.csv", "ok.csv")]
    assert [r.source_ordinal for r in MD.read_metadata(spark, paths).collect()] == [2]
