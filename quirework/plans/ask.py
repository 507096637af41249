"""One question from classification to cited answer: python -m quirework.plans.ask DIR "question"."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import embedding
from quirework.operators import agent, facts, retrieval


def ask(facts_table: DataFrame, ldus: DataFrame, question: str, k: int = 2) -> DataFrame:
    """(query, classification, final_answer), one row: quantitative questions from the facts, others from the k nearest units; no source, no answer."""
    spark = ldus.sparkSession
    q = spark.createDataFrame([(0, question)], "query_id int, query string").withColumn("classification", agent.classify(F.col("query")))
    if q.first()["classification"] == "quantitative":
        hit = facts.lookup(facts_table, q.select("query_id", "query"))
        state = hit.select("query_id", F.when(F.col("value").isNotNull(), F.concat(F.lit("SQL Result: "), F.col("value"))).otherwise("Numerical lookup yielded no results.").alias("retrieved_context"), F.when(F.col("value").isNotNull(), F.array(F.struct(F.lit("Fact_Table.sql").alias("document_name"), F.lit(0).alias("page_number")))).alias("provenance_links"))
    else:
        vectors = ldus.select(F.col("ldu_id").alias("item_id"), embedding.hashed(F.col("content")).alias("embedding"))
        near = retrieval.nearest(q.select("query_id", embedding.hashed(F.col("query")).alias("embedding")), vectors, k)
        found = near.join(agent.provenance(ldus).withColumnRenamed("ldu_id", "item_id"), "item_id")
        rows = F.array_sort(F.collect_list(F.struct("rank", "text_snippet", "document_name", "page_number")))
        got = found.groupBy("query_id").agg(rows.alias("r"))
        state = got.select("query_id", F.array_join(F.transform("r", lambda x: x["text_snippet"]), "\n").alias("retrieved_context"), F.transform("r", lambda x: F.struct(x["document_name"].alias("document_name"), x["page_number"].alias("page_number"))).alias("provenance_links"))
    done = q.join(state, "query_id", "left")
    return agent.synthesize(done).select("query", "classification", "final_answer")


def main(args: list[str]) -> None:
    if len(args) != 2:
        sys.exit(__doc__)
    spark = SparkSession.builder.getOrCreate()
    read = lambda name: spark.read.parquet(f"{args[0]}/{name}.parquet")
    print(ask(read("facts").dropDuplicates(["id"]), read("ldus").dropDuplicates(["ldu_id"]), args[1]).first()["final_answer"])


if __name__ == "__main__":
    main(sys.argv[1:])
