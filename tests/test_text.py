import hashlib

from pyspark.sql import functions as F

from quirework.functions import text as T


def test_hash_is_golden_and_ignores_pages(spark):
    content, box = "This is a stable content snippet.", [0.1, 0.2, 0.8, 0.3]
    got = spark.range(1).select(T.ldu_hash(F.lit(content), [F.lit(x) for x in box], F.lit("text")).alias("h")).first()["h"]
    assert got == "f399bd9cf7d17e3c0e399804e3193c8e64ec6963028a03217c74886fae7b0293"
    assert got == hashlib.sha256(f"{content}|bbox:{box}|type:text".encode()).hexdigest()


def test_float_text(spark):
    cases = {0.1: "0.1", 0.0005: "0.0005", 1.0: "1.0", 0.0: "0.0", 0.1234567: "0.1235", 0.100041: "0.1", 12.5: "12.5"}
    rows = spark.createDataFrame([(k,) for k in cases], "x double").select("x", T.float_text(F.col("x")).alias("t")).collect()
    assert {r["x"]: r["t"] for r in rows} == cases


def test_titles_like_the_language(spark):
    words = ["Financial Report", "FINANCIAL", "financial Report", "Éa Bc", "A1b", "A1 B", "1", "", "O'Neil", "Mc Donald", "McDonald", "Table 3.2", "Ünïcode Wörd", "x"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.is_title(F.col("w")).alias("t")).collect()
    assert {r["w"]: r["t"] for r in rows} == {w: w.istitle() for w in words}


def test_junk_words(spark):
    cases = {"Financial": False, "Report": False, "12,345.67": False, "a" * 41: True, "$$$$---11": True, "ssssss": True, "xxxxxxx": True, "": True, "***": True}
    rows = spark.createDataFrame([(w,) for w in cases], "w string").select("w", T.is_junk(F.col("w")).alias("j")).collect()
    assert {r["w"]: r["j"] for r in rows} == cases


def test_json_tokens_snippets(spark):
    cases = {'```json\n{"a": 1}\n```': '{"a": 1}', 'Here: {"a": {"b": 2}} done': '{"a": {"b": 2}}', "list [1, 2] end": "[1, 2]", " none ": "none"}
    rows = spark.createDataFrame([(w,) for w in cases], "w string").select("w", T.json_in(F.col("w")).alias("j")).collect()
    assert {r["w"]: r["j"] for r in rows} == cases
    r = spark.createDataFrame([(" a  b\nc ", None)], "s string, n string").select(T.token_count(F.col("s")).alias("a"), T.snippet(F.col("s"), 2).alias("b"), T.token_count(F.col("n")).alias("c"), T.strip(F.col("s")).alias("d")).first()
    assert (r["a"], r["b"], r["d"]) == (3, "a b...", "a  b\nc")
    nums = {"4.2B": 4.2, "150,000": 150.0, "x": None, "-3": -3.0, " .5 ": 0.5}
    rows = spark.createDataFrame([(w,) for w in nums], "w string").select("w", T.numeric_prefix(F.col("w")).alias("n")).collect()
    assert {r["w"]: r["n"] for r in rows} == nums
