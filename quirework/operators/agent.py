"""Questions: classified, answered with citations, claims audited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.text import snippet

# Substrings of quantitative questions (engine and command line).
QUANTITATIVE = ["total", "sum", "average", "revenue", "cost", "margin", "%", "$", "q1", "q2", "q3", "q4"]
QUANTITATIVE_CLI = ["year", "revenue", "cost", "total", "count", "number", "how many"]
REFUSAL = "I'm sorry, I cannot verify this answer with source citations."


def classify(query: Column, triggers: list[str] = QUANTITATIVE) -> Column:
    low = F.lower(query)
    hit = F.lit(False)
    for t in triggers:
        hit = hit | low.contains(t)
    return F.when(hit, "quantitative").otherwise("conceptual")


def citations(links: Column) -> Column:
    """[i] name (p.N), a line each; links ARRAY<STRUCT<document_name, page_number>>; unknown names and pages read Unknown and 1."""
    return F.array_join(F.transform(links, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(x["document_name"], F.lit("Unknown")), F.lit(" (p."), F.coalesce(x["page_number"], F.lit(1)).cast("string"), F.lit(")"))), "\n")


def synthesize(state: DataFrame) -> DataFrame:
    """state (retrieved_context, provenance_links) with final_answer; no links, no answer."""
    return state.withColumn("final_answer", F.when(F.size(F.coalesce("provenance_links", F.array())) > 0, F.concat(F.col("retrieved_context"), F.lit("\n\nSources:\n"), citations(F.col("provenance_links")))).otherwise(REFUSAL))


def provenance(ldus: DataFrame, key: str = "ldu_id") -> DataFrame:
    """(key, document_name, page_number, content_hash, text_snippet): first page, first 30 words."""
    return ldus.select(key, F.coalesce(F.col("metadata.document_name"), F.lit("Unknown")).alias("document_name"), F.coalesce(F.try_element_at("page_refs", F.lit(1)), F.lit(1)).alias("page_number"), "content_hash", snippet(F.col("content")).alias("text_snippet"))


def audit(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(claim_id, status, provenance_hashes): Verified where the claim stands in its sources (claim_id, content_hash, content) whatever the case, with all their hashes."""
    s = sources.groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_list(F.lower("content"))), " ").alias("t"), F.sort_array(F.collect_set("content_hash")).alias("h"))
    ok = F.col("t").contains(F.lower("claim"))
    return claims.join(s, "claim_id", "left").select("claim_id", F.when(ok, "Verified").otherwise("Not Found / Unverifiable").alias("status"), F.when(ok, F.col("h")).otherwise(F.array().cast("array<string>")).alias("provenance_hashes"))


def audit_within(units: DataFrame, group: str) -> DataFrame:
    """audit() of the claim of every unit (claim_id, claim, content_hash, content) against all other units of its group; a group is one row, so that texts are shuffled once."""
    alone = F.when(F.col(group).isNull(), F.col("claim_id"))
    g = units.groupBy(group, alone.alias("_alone")).agg(F.collect_list(F.struct("claim_id", "claim", "content_hash", F.lower("content").alias("t"))).alias("all"))
    others = g.select(F.explode("all").alias("c"), "all").select("c.claim_id", "c.claim", F.filter("all", lambda x: x["claim_id"] != F.col("c.claim_id")).alias("s"))
    ok = (F.size("s") > 0) & F.array_join(F.array_sort(F.col("s.t")), " ").contains(F.lower("claim"))
    hashes = F.array_sort(F.array_distinct(F.filter("s.content_hash", lambda h: h.isNotNull())))
    return others.select("claim_id", F.when(ok, "Verified").otherwise("Not Found / Unverifiable").alias("status"), F.when(ok, hashes).otherwise(F.array().cast("array<string>")).alias("provenance_hashes"))
