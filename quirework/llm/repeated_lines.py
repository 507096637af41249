"""Lines repeated across the documents of one source.

Lines are compared by a hash of their letters. Distinct documents are counted for each source and hash (first distinct
source, hash, document, then a count: both combine before the shuffle, so a hot source spreads over its lines), lines
above the share of the source's documents are joined back, and the texts are rebuilt without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_FILES, LEAST_SHARE = 4, 3, 0.2


def letters(line: Column) -> Column:
    """The line's words in lower case, of letters alone, one space apart."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}]+", " "))


def keyed_lines(blocks: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(block_id, doc_id, source, line_no, h) of the lines of at least least_words words; null texts have none."""
    lines = blocks.select("block_id", "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.length("line") >= 2 * least_words - 1).withColumn("n", letters(F.col("line"))).filter(F.size(F.split("n", " ")) >= least_words).select("block_id", "doc_id", "source", "line_no", F.xxhash64("n").alias("h"))


def frequent_lines(blocks: DataFrame, least_words: int = LEAST_WORDS, least_files: int = LEAST_FILES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(source, h, files, source_files, example): lines in at least least_files documents and least_share of the documents of the source.

    A null source is a source of its own; rows with null doc_id count for no document. example is the least spelling.
    """
    usable = blocks.filter("doc_id IS NOT NULL")
    lines = usable.select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= 2 * least_words - 1).withColumn("n", letters(F.col("line"))).filter(F.size(F.split("n", " ")) >= least_words)
    counted = lines.groupBy("source", F.xxhash64("n").alias("h"), "doc_id").agg(F.min("n").alias("n")).groupBy("source", "h").agg(F.count("*").alias("files"), F.min("n").alias("example")).filter(F.col("files") >= least_files)
    sizes = usable.select("source", "doc_id").distinct().groupBy("source").agg(F.count("*").alias("source_files"))
    joined = counted.withColumnRenamed("source", "s").join(sizes, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    return joined.filter(F.col("files") >= least_share * F.col("source_files") - 1e-9).select("source", "h", "files", "source_files", "example")


def repeated_lines(blocks: DataFrame, **limits: float) -> DataFrame:
    """(block_id, line_no), distinct: the frequent lines where they stand. Blocks delivered again count once."""
    frequent = frequent_lines(blocks, **limits).select(F.col("source").alias("s"), F.col("h").alias("k"))
    lines = keyed_lines(blocks.filter("block_id IS NOT NULL AND doc_id IS NOT NULL"), int(limits.get("least_words", LEAST_WORDS)))
    return lines.join(frequent, (F.col("h") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")), "left_semi").select("block_id", "line_no").distinct()


def without_repeated(blocks: DataFrame, **limits: float) -> DataFrame:
    """(doc_id, page_number, block_ix, block_id, text, lines_removed): every block once, without the frequent lines; a block of only such lines is left out.

    Blocks with a null text keep it. One row a block: a file of any size is never gathered in one task.
    """
    once = blocks.select("doc_id", "page_number", "block_ix", "block_id", "text").dropDuplicates(["block_id"])
    gone = repeated_lines(blocks, **limits).groupBy("block_id").agg(F.collect_set("line_no").alias("gone"))
    kept = once.join(gone, "block_id", "left").withColumn("_lines", F.split("text", "\n"))
    kept = kept.withColumn("_left", F.when(F.col("gone").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x, i: ~F.array_contains("gone", i))))
    return kept.filter(F.col("text").isNull() | (F.size("_left") > 0)).select("doc_id", "page_number", "block_ix", "block_id", F.when(F.col("text").isNotNull(), F.array_join("_left", "\n")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed"))
