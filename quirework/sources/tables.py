"""Sources and sinks: files by hash, JSON documents, ledgers, vector and section tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirework.operators.sections import first_rows

REQUIRED = ["file_hash", "strategy", "status", "at"]


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, modified, doc_id): one row a file, doc_id the SHA-256 of its bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("doc_id"))


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Documents of one JSON object each, with a stated schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str, sort_keys: bool = True) -> None:
    """One JSON line a row, columns in the order of their names."""
    (df.select(*sorted(df.columns)) if sort_keys else df).write.mode("overwrite").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger lines; malformed ones are left out."""
    return spark.read.schema("file_hash string, strategy string, status string, confidence double, at string").option("mode", "DROPMALFORMED").json(path)


def append_ledger(records: DataFrame, path: str, required: list[str] = REQUIRED) -> None:
    """Appends records that have all required fields; raises ValueError if one lacks any, before anything is written. signals MAP becomes sig_ columns in one map."""
    absent = [c for c in required if c not in records.columns]
    if absent:
        raise ValueError(f"missing fields: {absent}")
    bad = records.filter(" OR ".join(f"{c} IS NULL" for c in required))
    if not bad.isEmpty():
        raise ValueError("a record lacks a required field")
    out = records.withColumn("signals", F.transform_keys("signals", lambda k, _: F.concat(F.lit("sig_"), k))) if "signals" in records.columns else records
    out.write.mode("append").json(path)


def upsert(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """stored and new, the newer row of each key; a key twice in new is an error of the caller's (dedupe first), here the greatest row wins."""
    both = stored.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return first_rows(both, [key], [F.desc("_v"), F.desc(F.xxhash64(*new.columns))]).drop("_v")


def block_texts(blocks: DataFrame) -> DataFrame:
    """Parser blocks (type, text, content, lines ARRAY<STRUCT<spans ARRAY<STRUCT<content>>>>, x0, y0, x1, y1) with kind and text from the first filled field; degenerate boxes are left out."""
    spans = F.array_join(F.flatten(F.transform("lines", lambda x: F.transform(x["spans"], lambda s: s["content"]))), " ")
    text = F.coalesce(F.nullif("text", F.lit("")), F.nullif("content", F.lit("")), F.nullif(spans, F.lit("")), F.lit(""))
    kind = F.when(F.col("type").isin("table", "table_body"), "table").when(F.col("type").isin("image", "figure"), "figure").when(F.col("type") == "title", "header").otherwise("text")
    return blocks.filter("x0 < x1 AND y0 < y1").withColumn("kind", kind).withColumn("text", text)


def page_overlay(ldus: DataFrame, pages: DataFrame) -> DataFrame:
    """(ldu_id, doc_id, page_number, px0, py0, px1, py1, colour): boxes in the units of pages (doc_id, page_number, width, height), on the first page of each unit."""
    # A colour for each type.
    colour = F.create_map(*[F.lit(x) for p in {"header": "red", "text": "blue", "table": "green", "figure": "orange", "list": "purple"}.items() for x in p])
    u = ldus.withColumn("page_number", F.try_element_at("page_refs", F.lit(1)))
    b = lambda c, side: F.round(F.col(f"bounding_box.{c}") * F.col(side), 4)
    return u.join(pages, ["doc_id", "page_number"]).select("ldu_id", "doc_id", "page_number", b("x0", "width").alias("px0"), b("y0", "height").alias("py0"), b("x1", "width").alias("px1"), b("y1", "height").alias("py1"), F.coalesce(colour[F.col("chunk_type")], F.lit("grey")).alias("colour"))
