"""The fact table: ingest, typed view, read-only SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import numeric_prefix
from quirework.session import materialize

COLUMNS = ["document_name", "section_title", "entity", "value", "unit", "time_period", "fact_type", "source_hash"]


#: Classes a parsed SELECT may have at its top.
_QUERY_NODES = {"Project", "Filter", "Aggregate", "UnresolvedHaving", "Distinct", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Union", "Intersect", "Except", "UnresolvedWith", "WithWindowDefinition", "Join", "SubqueryAlias", "Generate", "Pivot", "UnresolvedSubqueryColumnAliases"}


class QueryRejectedError(ValueError):
    """The statement is not a single SELECT."""


def ingest(facts: DataFrame, new: DataFrame) -> DataFrame:
    """facts and new (without id); new rows get ids after the greatest, without gaps by partition order, nothing is deduplicated.

    Ids come from zip-like offsets (count per partition, then a running sum over partitions), not from a window over all rows.
    new is written to the shared folder first, so that counting and numbering see the same rows.
    """
    new = materialize(new, "ingest")
    last = facts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    placed = new.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    sizes = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}  # one row a partition
    offsets, total = {}, last
    for p in sorted(sizes):
        offsets[p], total = total, total + sizes[p]
    if not offsets:
        return facts
    offset = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    within = F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33)
    ids = placed.withColumn("id", (offset[F.col("_p")] + within + 1).cast("bigint")).drop("_p", "_i")
    return facts.unionByName(ids, allowMissingColumns=True)


def typed(facts: DataFrame) -> DataFrame:
    """facts with value_num, the number value begins with (as SQLite reads text), null if none."""
    return facts.withColumn("value_num", numeric_prefix(F.col("value")))


def query(spark: SparkSession, facts: DataFrame, sql: str, args: dict | None = None, view: str = "facts") -> DataFrame:
    """A read-only query over the view; raises QueryRejectedError for anything but a single SELECT (also WITH, as the guard is by prefix)."""
    if not sql.strip().upper().startswith("SELECT"):
        raise QueryRejectedError("QueryRejectedError: only SELECT is allowed")
    node = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if node.getClass().getSimpleName() not in _QUERY_NODES:
        raise QueryRejectedError("QueryRejectedError: only SELECT is allowed")
    typed(facts).createOrReplaceTempView(view)
    return spark.sql(sql, args=args or {})


def lookup(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, term, value): of each question (query_id, query) the value of the least id whose entity is LIKE '%term%', the last word; null if none.

    Case does not count; % and _ in the term are wildcards. Terms and entities are looked up once each, however often they
    come, and joined on a run of up to three characters: the first of the longest part of the term without wildcards, which every entity that matches
    holds. A term of wildcards only is compared with the lengths of entities.
    """
    q = questions.select("query_id", F.lower(F.try_element_at(F.filter(F.split(F.regexp_replace("query", r"\?+\s*$", ""), r"\s+"), lambda x: x != ""), F.lit(-1))).alias("term"))
    parts = F.filter(F.split("term", "[%_]"), lambda x: x != "")
    longest = F.aggregate(parts, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    terms = q.select("term").filter("term IS NOT NULL").distinct().withColumn("gram", F.left(longest, F.lit(3)))
    best = lambda rows, key: rows.groupBy(key).agg(F.min_by("value", "id").alias("value"))
    entities = facts.filter("entity IS NOT NULL").groupBy(F.lower("entity").alias("e")).agg(F.min_by("value", "id").alias("value"), F.min("id").alias("id"))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("e"), F.lit(1))), lambda i: F.array(*[F.substring("e", i, F.lit(n)) for n in (1, 2, 3)]))))
    held = entities.select("e", "value", "id", F.explode(grams).alias("gram"))
    like = F.like("e", F.concat(F.lit("%"), F.replace(F.col("term"), F.lit("\\"), F.lit("\\\\")), F.lit("%")))
    hits = best(held.join(terms.filter("gram <> ''"), "gram").filter(like), "term")
    # The least id of every length; a term matches entities of its own length at least.
    lengths = entities.groupBy(F.length("e").alias("n")).agg(F.min_by("value", "id").alias("value"), F.min("id").alias("id"))
    by_length = lengths.select("value", "id", F.explode(F.sequence(F.lit(0), "n")).alias("n"))
    wild = best(terms.filter("gram = ''").withColumn("n", F.length(F.regexp_replace("term", "%", ""))).join(by_length, "n"), "term")
    return q.join(hits.unionByName(wild), "term", "left").select("query_id", "term", "value")


# What a number is counted in, for the default provider.
_UNITS = "percent|million|billion|thousand|units|lakh|birr|USD|kg|km"


def extract(ldus: DataFrame, key: str = "ldu_id") -> DataFrame:
    """(key, entity, value, unit) of the default provider: every number followed by a unit, with the two words before it. Null content gives none. No shuffle."""
    pattern = rf"((?:[\p{{L}}'’-]+\s+){{0,2}})(\d[\d.,]*)\s+({_UNITS})\b"
    hits = ldus.select(key, F.explode(F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "entity"), (2, "value"), (3, "unit"))])).alias("x"))
    return hits.select(key, F.trim(F.regexp_replace("x.entity", r"\s+", " ")).alias("entity"), "x.value", "x.unit")
