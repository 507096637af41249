"""Nearest neighbours, exact: global, within sections, hybrid; recall."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries and items that meet in one task, at most about.
QUERIES_A_BLOCK, ITEMS_A_BLOCK = 2_000, 50_000
#: Distances that are equal to so many places are ties.
PLACES = 9
_AT_ONCE = 4_000_000


def nearest(queries: DataFrame, items: DataFrame, k: int = 3, restrict: bool = False, query_block: int = QUERIES_A_BLOCK, item_block: int = ITEMS_A_BLOCK) -> DataFrame:
    """(query_id, item_id, distance, rank): the k items of the least squared L2 distance (to PLACES places), ties by item_id.

    queries (query_id, embedding), items (item_id, embedding); with restrict both have section and only items of the query's
    section count, unless its section is null (no filter). Queries and items are dealt by hash into blocks of a counted size, within
    their section if that restricts, and every pair of blocks meets in one task by an equi-join on section and blocks, which keeps k rows a query. Nothing
    goes through the driver but two counts. Null ids and embeddings, and embeddings of another length than the queries', are not compared.
    """
    q = queries.filter("query_id IS NOT NULL AND embedding IS NOT NULL").select("query_id", "embedding", (F.col("section") if restrict else F.lit(None).cast("string")).cast("string").alias("section"))
    x = items.filter("item_id IS NOT NULL AND embedding IS NOT NULL").select("item_id", "embedding", (F.col("section") if restrict else F.lit(None).cast("string")).cast("string").alias("section"))
    found = _met(q.filter("section IS NULL").drop("section"), x.drop("section"), k, query_block, item_block)
    if restrict:
        found = found.unionByName(_met_within(q.filter("section IS NOT NULL"), x.filter("section IS NOT NULL"), k, query_block, item_block))
    w = Window.partitionBy("query_id").orderBy("distance", "item_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _part(key: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")


def _met(q: DataFrame, x: DataFrame, k: int, query_block: int, item_block: int) -> DataFrame:
    cores = q.sparkSession.sparkContext.defaultParallelism
    nq = max(1, -(-q.count() // query_block))
    nx = max(-(-cores // nq), -(-x.count() // item_block))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = q.select("*", _part("query_id", F.lit(nq)).alias("qb"), every(nx, "xb"), F.lit("").alias("section"))
    right = x.select("*", _part("item_id", F.lit(nx)).alias("xb"), every(nq, "qb"), F.lit("").alias("section"))
    return _compared(left, right, k)


def _met_within(q: DataFrame, x: DataFrame, k: int, query_block: int, item_block: int) -> DataFrame:
    count = lambda df, size, name: df.groupBy("section").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = count(q, query_block, "nq").join(count(x, item_block, "nx"), "section")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    left = q.join(sizes, "section").select("query_id", "embedding", "section", _part("query_id", F.col("nq")).alias("qb"), every("nx", "xb"))
    right = x.join(sizes, "section").select("item_id", "embedding", "section", _part("item_id", F.col("nx")).alias("xb"), every("nq", "qb"))
    return _compared(left, right, k)


def _compared(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """The k best items of each query within a pair of blocks."""

    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        for length, some in q.groupby(q["embedding"].map(len)):
            same = x[x["embedding"].map(len) == length]
            if len(same):
                out.append(_least(some["query_id"].to_numpy(), np.array(some["embedding"].tolist(), np.float64), same["item_id"].to_numpy(), np.array(same["embedding"].tolist(), np.float64), k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": q["query_id"][:0], "item_id": x["item_id"][:0], "distance": pd.Series(dtype="float64")})

    schema = f"query_id {left.schema['query_id'].dataType.simpleString()}, item_id {right.schema['item_id'].dataType.simpleString()}, distance double"
    keys = ["section", "qb", "xb"]
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))  # both may come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, schema)


def _least(ids: np.ndarray, q: np.ndarray, items: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """Distances of a block of queries by one matrix product; those that may be among the k least are then computed exactly."""
    norms, parts = (x * x).sum(1), []
    step = max(1, _AT_ONCE // len(x))
    for lo in range(0, len(q), step):
        some = q[lo : lo + step]
        rough = norms - 2 * some @ x.T
        own = (some * some).sum(1)
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(x) > k else rough.max(1)
        row, col = np.nonzero(rough <= (kth + 1e-9 * (1 + own + np.abs(kth)))[:, None])
        d = np.round(((some[row] - x[col]) ** 2).sum(1), PLACES)
        order = np.lexsort((items[col], d, row))
        row, col, d = row[order], col[order], d[order]
        first = np.searchsorted(row, np.arange(len(some)))
        keep = np.arange(len(row)) - first[row] < k
        parts.append(pd.DataFrame({"query_id": ids[lo + row[keep]], "item_id": items[col[keep]], "distance": d[keep]}))
    return pd.concat(parts)


def hybrid(queries: DataFrame, items: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, item_id, distance, source): the k best within the section and the k best of all, each item once (sections first), by distance; up to 2k rows a query."""
    a = nearest(queries, items, k, restrict=True).select("query_id", "item_id", "distance", F.lit(0).alias("src"))
    b = nearest(queries, items, k).select("query_id", "item_id", "distance", F.lit(1).alias("src"))
    once = a.unionByName(b).groupBy("query_id", "item_id").agg(F.min_by("distance", "src").alias("distance"), F.min("src").alias("src"))
    return once.select("query_id", "item_id", "distance", F.when(F.col("src") == 0, "section").otherwise("global").alias("source"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): share of truth (query_id, item_id) that was found; queries without truth are left out."""
    hits = truth.distinct().join(found.select("query_id", "item_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left")
    return hits.groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
