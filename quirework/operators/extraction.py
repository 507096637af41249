"""Signals of extraction quality, health, attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions.text import clamp, is_junk, tokens


def page_confidence(pages: DataFrame) -> DataFrame:
    """pages (text, image_ratio, font_count, char_density) with junk_share and confidence: structure and text quality, the lesser of both."""
    words = tokens(F.coalesce("text", F.lit("")))
    chars = F.length(F.coalesce("text", F.lit("")))
    out = pages.withColumn("_t", words).withColumn("junk_share", F.when(F.size("_t") > 0, F.size(F.filter("_t", is_junk)) / F.size("_t")).otherwise(1.0))
    s = F.lit(1.0) * F.when(chars < 100, 0.1).otherwise(1.0)
    s = F.when((F.col("image_ratio") > 0.5) & (chars < 50), 0.0).when(F.col("image_ratio") > 0.5, s * 0.5).otherwise(s)
    s = s * F.when((F.col("font_count") == 0) & (chars > 0), 0.5).otherwise(1.0) * F.when((F.col("char_density") < 0.0005) & (chars > 0), 0.8).otherwise(1.0)
    quality = F.when(F.col("junk_share") > 0.3, 0.0).otherwise(1 - F.col("junk_share"))
    return out.drop("_t").withColumn("confidence", F.round(F.least(s, quality), 6))


def document_confidence(pages: DataFrame) -> DataFrame:
    """(doc_id, confidence, mean_quality, all_healthy): the least of the pages, the mean quality, whether every page has some confidence."""
    return pages.groupBy("doc_id").agg(F.min("confidence").alias("confidence"), F.round(F.avg(1 - F.col("junk_share")), 6).alias("mean_quality"), F.bool_and(F.col("confidence") > 0).alias("all_healthy"))


def totals(blocks: DataFrame) -> DataFrame:
    """(doc_id, pages, pages_with_content, blocks, tables, figures, headers, chars, empty_pages) of blocks (doc_id, page_number, text, kind). A page of blank blocks only is empty, one without blocks is not there."""
    text = F.coalesce("text", F.lit(""))
    page = blocks.groupBy("doc_id", "page_number").agg(F.count("*").alias("b"), F.count_if(F.col("kind") == "table").alias("t"), F.count_if(F.col("kind") == "figure").alias("f"), F.count_if(F.col("kind") == "header").alias("h"), F.sum(F.length(text)).alias("c"), F.bool_and(F.trim(text) == "").alias("e"))
    return page.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(~F.col("e")).alias("pages_with_content"), F.sum("b").alias("blocks"), F.sum("t").alias("tables"), F.sum("f").alias("figures"), F.sum("h").alias("headers"), F.sum("c").alias("chars"), F.count_if("e").alias("empty_pages"))


def confidences(t: DataFrame) -> DataFrame:
    """totals with layout_confidence, ocr_confidence and vision_confidence; documents without pages or blocks have 0."""
    pages = F.greatest("pages", F.lit(1))
    ratio = F.col("headers") / F.greatest("blocks", F.lit(1))
    lay = F.least(F.lit(1.0), 0.5 + F.col("blocks") / (pages * 50) * 0.4) + F.when(ratio > 0.5, 0.1).otherwise(-0.1)
    lay = F.when((F.col("blocks") == F.col("tables")) & (F.col("tables") > 0), 0.8).when(F.col("blocks") == 0, 0.0).otherwise(lay)
    comp, struct = F.col("pages_with_content") / pages, F.least(F.lit(1.0), F.col("blocks") / (10 * pages))
    ocr = 0.4 * comp + 0.3 * F.when(F.col("tables") > 0, F.least(F.lit(1.0), 0.8 + 0.02 * F.col("tables"))).otherwise(0.5) + 0.2 * struct + 0.1 * 0.92
    vis = 0.5 + F.when(F.col("blocks") / pages > 2, 0.2).otherwise(0.0) + F.when(F.col("chars") / pages > 100, 0.2).otherwise(0.0)
    return t.withColumns({"layout_confidence": F.round(clamp(lay), 6), "ocr_confidence": F.round(F.when(F.col("blocks") > 0, clamp(ocr, 0.1)).otherwise(0.0), 6), "vision_confidence": F.round(vis, 6)})


def health(t: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, completeness, content_health, score, flag) of totals against expected (doc_id, page_count): LOW where either is under a half."""
    j = t.join(expected, "doc_id")
    comp, good = F.col("pages") / F.greatest(F.lit(1), F.coalesce("page_count", F.lit(0))), 1 - F.col("empty_pages") / F.greatest(F.lit(1), F.col("pages"))
    return j.select("doc_id", F.round(comp, 6).alias("completeness"), F.round(good, 6).alias("content_health"), F.round(clamp(comp * good), 6).alias("score"), F.when((comp < 0.5) | (good < 0.5), "LOW").otherwise("HEALTHY").alias("flag"))


def weighted_confidence(t: DataFrame, score: str = "score") -> DataFrame:
    """t (comp, lay, struct, ocr, score, pages) with weighted_confidence: weighted signals times the score, at least 0.1 where there are pages."""
    w = (0.4 * F.col("comp") + 0.3 * F.col("lay") + 0.2 * F.col("struct") + 0.1 * F.col("ocr")) * F.col(score)
    return t.withColumn("weighted_confidence", F.round(F.when((w < 0.1) & (F.col("pages") > 0), 0.1).otherwise(w), 6))


def attempts(ledger: DataFrame) -> DataFrame:
    """(file_hash, strategy, attempts, last_at) of all lookups at once."""
    return ledger.groupBy("file_hash", "strategy").agg(F.count("*").alias("attempts"), F.max("at").alias("last_at"))


def missing_fields(records: DataFrame, required: list[str], fields: str = "fields") -> DataFrame:
    """Records (fields MAP) that lack a required key, with those keys."""
    gap = F.array_except(F.array(*[F.lit(r) for r in required]), F.map_keys(fields))
    return records.withColumn("missing", gap).filter(F.size("missing") > 0)


def running_prefix(spends: DataFrame, key: str, order: str, cost: str, cap: float) -> DataFrame:
    """spends whose running sum within key, in order, stays within cap, from the first on (a sequential budget)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = spends.withColumn("running", F.sum(cost).over(w))
    return s.withColumn("_ok", F.min((F.col("running") <= cap).cast("int")).over(w)).filter("_ok = 1").drop("_ok")
