from pyspark.sql import functions as F

from quirework.llm import repeated_lines as R

BLOCKS = "block_id bigint, doc_id string, source string, page_number int, block_ix int, text string"


def table(spark):
    rows = []
    for d in range(10):
        rows.append((d, f"d{d}", "s", 1, 0, f"Own text of file {'abcdefghij'[d]} alone\n" + ("(c) 2017 ALL rights of Owner, reserved" if d < 4 else "nothing") + ("\nthree words only" if d < 9 else "")))
    rows += [rows[0], (50, "d0", "s", 1, 1, "all rights of owner reserved"), (60, "x", "t", 1, 0, "All rights of owner reserved"), (61, None, "s", 1, 0, "c all rights of owner reserved"), (None, "d9", "s", 1, 2, None), (62, "d9", None, 1, 3, "")]
    return spark.createDataFrame(rows, BLOCKS)


def test_found_and_cleaned(spark):
    df = table(spark).withColumn("h", F.lit(1)).withColumn("n", F.lit("x")).withColumn("gone", F.lit(2))
    assert {tuple(r) for r in R.repeated_lines(df).collect()} == {(d, 1) for d in range(4)}
    lines = R.frequent_lines(df).collect()
    assert [(r["source"], r["files"], r["source_files"]) for r in lines] == [("s", 4, 10)]
    kept = {r["block_id"]: (r["text"], r["lines_removed"]) for r in R.without_repeated(df).collect()}
    assert kept[0] == ("Own text of file a alone\nthree words only", 1) and kept[9][1] == 0 and kept[None] == (None, 0) and kept[62] == ("", 0)


def test_share_is_of_the_source(spark):
    rows = [(i, f"d{i}", "s", 1, 0, "one two three four" if i < 3 else "x") for i in range(16)]
    assert R.repeated_lines(spark.createDataFrame(rows, BLOCKS)).count() == 0
    assert R.repeated_lines(spark.createDataFrame(rows[:15], BLOCKS)).count() == 3


def test_empty(spark):
    e = spark.createDataFrame([], BLOCKS)
    assert R.repeated_lines(e).count() == 0 and R.without_repeated(e).count() == 0
