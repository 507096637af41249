import pytest
from pyspark.sql import functions as F

from quirework.operators import extraction, geometry, triage

STATS = "doc_id string, page_ix int, ink_density double, char_density double, whitespace_ratio double, image_ratio double, font_count bigint, vector_count bigint"


def test_origins(spark):
    dig, scan, amb = (0.08, 0.0, 0.7, 0.0, 5, 20), (0.0, 0.0, 0.99, 0.95, 0, 0), (0.03, 0.0, 0.96, 0.3, 1, 3)
    rows = [("d", i, *dig) for i in range(3)] + [("s", i, *scan) for i in range(3)] + [("m", 0, *dig), ("m", 1, *scan), ("a", 0, *amb)]
    pages = triage.origin_pages(spark.createDataFrame(rows, STATS))
    score = {(r["doc_id"], r["page_ix"]): r["page_score"] for r in pages.collect()}
    assert score["d", 0] == 0.815789 and score["s", 0] == 0.01 and score["a", 0] == 0.65
    got = {r["doc_id"]: (r["origin_type"], r["origin_confidence"]) for r in triage.origins(pages).collect()}
    assert got["d"] == ("digital_native", 0.815789) and got["s"] == ("scanned", 0.99) and got["a"] == ("digital_native", 0.65)
    assert got["m"][0] == "mixed" and got["m"][1] == pytest.approx(0.825789, abs=2e-6)


LAY = "doc_id string, page_ix int, unique_fonts int, graphic_groups int, line_height_variance double, columns int, tables_detected int, image_ratio double"


def test_layouts(spark):
    rows = [("simple", 0, 1, 0, 1.0, 1, 0, 0.0), ("tables", 0, 1, 1, 0.0, 1, 4, 0.0), ("columns", 0, 1, 0, 0.0, 3, 0, 0.0), ("figures", 0, 1, 0, 1.0, 1, 0, 0.85), ("complex", 0, 12, 1, 50.0, 3, 6, 0.0)]
    got = {r["doc_id"]: (r["layout_type"], r["layout_confidence"]) for r in triage.layouts(triage.layout_signals(spark.createDataFrame(rows, LAY))).collect()}
    assert got["simple"] == ("single_column", 0.333333) and got["tables"] == ("table_heavy", 0.516667)
    assert got["columns"] == ("multi_column", 1.0) and got["figures"] == ("figure_heavy", 0.516667) and got["complex"] == ("mixed", 0.05)


def test_samples(spark):
    cases = {0: [], 1: [0], 3: [0, 1, 2], 5: [0, 1, 2, 3, 4], 6: [0, 1, 3, 4, 5], 100: [0, 1, 50, 98, 99], None: []}
    rows = spark.createDataFrame([(k,) for k in cases], "n int").select("n", triage.sample_pages(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in rows} == cases


def test_domains(spark):
    fin = "The bank reported revenue and profit; the audit of capital, equity and loans is complete for the shareholders. " * 5
    gov = "The ministry and the federal government agency reviewed policy, administration and governance in public sector bureaus. " * 5
    rows = [("f", fin), ("g", gov), ("u", fin.upper()), ("s", "short text"), ("l", "lorem ipsum " * 60), ("n", None)]
    got = {r["doc_id"]: (r["domain_hint"], r["domain_confidence"]) for r in triage.domains(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got["f"][0] == got["u"][0] == "financial" and got["g"][0] == "governmental" and got["s"] == got["l"] == got["n"] == ("general", 0.0)


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        triage.TriageConfig(origin_weights={"ink": 1.0, "whitespace": 0.25})


def test_columns_and_variance(spark):
    rows = [("d", 0, x / 100, i / 10) for i, x in enumerate([5, 6, 7, 30, 31, 55])] + [("e", 0, 0.1, 0.5)]
    b = spark.createDataFrame(rows, "doc_id string, page_ix int, x0 double, y0 double")
    assert {r["doc_id"]: r["columns"] for r in triage.column_estimates(b).collect()} == {"d": 3, "e": 1}
    assert {r["doc_id"]: round(r["line_height_variance"], 9) for r in triage.line_variance(b).collect()} == {"d": 0.0, "e": 0.0}


def test_boxes(spark):
    b = spark.createDataFrame([("d", 1, i, float(a), float(c)) for i, (a, c) in enumerate([(0.6, 0.1), (0.1, 0.3), (0.1, 0.1)])], "doc_id string, page_number int, block_ix int, x0 double, y0 double").withColumns({"x1": F.col("x0") + 0.3, "y1": F.col("y0") + 0.1})
    got = [(r["block_ix"], r["column_id"]) for r in geometry.reading_order(b).orderBy("reading_order").collect()]
    assert got == [(2, 0), (1, 0), (0, 1)]
    near = spark.createDataFrame([("a", 1, 4.0 * i, 0.0, 4.0 * i + 5, 5.0) for i in range(10)] + [("b", 1, 0.0, 0.0, 5.0, 5.0), ("b", 1, 500.0, 0.0, 505.0, 5.0)], "doc_id string, page_number int, x0 double, y0 double, x1 double, y1 double")
    assert {r["doc_id"]: r["groups"] for r in geometry.group_counts(near, 5.0).collect()} == {"a": 1, "b": 2}


def test_page_confidence(spark):
    rows = [("d", "", 0.0, 0, 0.0), ("e", "plain words of a page " * 20, 0.0, 2, 0.01), ("f", "ssssss ssssss xxxxxxx " * 20, 0.0, 2, 0.01)]
    p = spark.createDataFrame(rows, "doc_id string, text string, image_ratio double, font_count int, char_density double")
    got = {r["doc_id"]: r["confidence"] for r in extraction.page_confidence(p).collect()}
    assert got["d"] < 0.2 and got["e"] == 1.0 and got["f"] == 0.0
