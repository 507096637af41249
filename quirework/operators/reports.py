"""Reports on densities, markdown structure and two extractions side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.text import strip


def density(blocks: DataFrame, page_area: float = 1.0) -> DataFrame:
    """(doc_id, total_chars, pages, box heights and widths, page_char_variance, avg_whitespace, avg_vectors, hint)."""
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    page = blocks.groupBy("doc_id", "page_number").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("c"), (1 - F.sum(h * w) / page_area).alias("ws"), F.count_if(F.col("text").contains("|")).alias("v"))
    boxes = blocks.groupBy("doc_id").agg(F.avg(h).alias("hm"), F.coalesce(F.stddev_samp(h), F.lit(0.0)).alias("hs"), F.avg(w).alias("wm"), F.coalesce(F.stddev_samp(w), F.lit(0.0)).alias("wsd"))
    d = page.groupBy("doc_id").agg(F.sum("c").alias("total_chars"), F.count("*").alias("pages"), F.coalesce(F.var_samp("c"), F.lit(0.0)).alias("var"), F.avg("ws").alias("ws"), F.avg("v").alias("v"))
    hint = F.when((F.col("ws") > 0.95) & (F.col("total_chars") / F.col("pages") < 500) & (F.col("v") < 5), "likely_scanned").when(F.col("v") > 20, "layout_complex").otherwise("likely_native")
    return d.join(boxes, "doc_id").select("doc_id", "total_chars", "pages", F.round("hm", 6).alias("bbox_height_mean"), F.round("hs", 6).alias("bbox_height_std"), F.round("wm", 6).alias("bbox_width_mean"), F.round("wsd", 6).alias("bbox_width_std"), F.round("var", 4).alias("page_char_variance"), F.round("ws", 6).alias("avg_whitespace"), F.round("v", 6).alias("avg_vectors"), hint.alias("hint"))


def markdown(documents: DataFrame, key: str = "doc_id", text: str = "text", tables: Column | None = None, with_headers: Column | None = None) -> DataFrame:
    """(key, chars, num_headings, num_list_markers, avg_line_length, empty_line_ratio, failure_modes); a null text counts as empty. No shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n")
    d = documents.select(F.col(key), F.length(t).alias("chars"), lines.alias("l"), (tables if tables is not None else F.lit(0)).alias("t"), (with_headers if with_headers is not None else F.lit(0)).alias("h"))
    d = d.withColumn("s", F.transform("l", strip)).withColumn("full", F.filter("l", lambda x: strip(x) != ""))
    d = d.withColumns({"num_headings": F.size(F.filter("s", lambda x: x.startswith("#"))), "num_list_markers": F.size(F.filter("s", lambda x: x.startswith("- ") | x.startswith("* "))), "avg_line_length": F.when(F.size("full") > 0, F.round(F.aggregate("full", F.lit(0), lambda a, x: a + F.length(x)) / F.size("full"), 4)).otherwise(0.0), "empty_line_ratio": F.round((F.size("l") - F.size("full")) / F.size("l"), 6)})
    modes = F.array(F.when(F.col("chars") == 0, "empty_output").when(F.col("chars") < 500, "extremely_short_markdown"), F.when((F.col("t") > 0) & (F.col("h") == 0), "header_loss"), F.when((F.col("num_headings") == 0) & (F.col("chars") > 1000), "layout_flattening"))
    return d.select(key, "chars", "num_headings", "num_list_markers", "avg_line_length", "empty_line_ratio", F.array_join(F.filter(modes, lambda x: x.isNotNull()), ",").alias("failure_modes"))


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, difference, ratio, issues) of character counts (doc_id, chars, hint) and (doc_id, chars)."""
    j = first.select("doc_id", F.col("chars").alias("a"), "hint").join(second.select("doc_id", F.col("chars").alias("b")), "doc_id")
    ratio = F.when(F.col("a") > 0, F.col("b") / F.col("a")).otherwise(0.0)
    issues = F.array(F.when((ratio < 0.5) & (F.col("a") > 1000), "severe_text_loss").when((ratio > 1.5) & (F.col("a") > 1000), "potential_hallucination_or_over_segmentation"), F.when((F.col("hint") == "likely_scanned") & (ratio < 0.2), "scanned_pdf_failure"))
    return j.select("doc_id", (F.col("b") - F.col("a")).alias("difference"), F.round(ratio, 2).alias("ratio"), F.array_join(F.filter(issues, lambda x: x.isNotNull()), ",").alias("issues"))


def table_header_ratio(tables: DataFrame, key: str = "ldu_id", text: str = "content") -> DataFrame:
    """(key, rows, header_ratio): 1 / (rows + 1) of each markdown table, 0 without a separator line."""
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    sep = F.exists(lines, lambda x: x.rlike(r"^[|\-: ]+$") & x.contains("-"))
    rows = F.greatest(F.size(lines) - 2, F.lit(0))
    return tables.select(key, rows.alias("rows"), F.when(sep, F.round(1 / (rows + 1), 6)).otherwise(0.0).alias("header_ratio"))
