"""Boxes: normalisation, reading order, connected groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions.text import clamp


def normalize_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, bottom_left: Column) -> Column:
    """STRUCT<x0, y0, x1, y1> in [0, 1], origin top left, corners in order; zeros where width or height is not positive."""
    a, c = clamp(x0 / width), clamp(x1 / width)
    b, d = clamp(y0 / height), clamp(y1 / height)
    b, d = F.when(bottom_left, 1 - b).otherwise(b), F.when(bottom_left, 1 - d).otherwise(d)
    ok = (width > 0) & (height > 0)
    z = lambda v: F.when(ok, v).otherwise(F.lit(0.0))
    return F.struct(z(F.least(a, c)).alias("x0"), z(F.least(b, d)).alias("y0"), z(F.greatest(a, c)).alias("x1"), z(F.greatest(b, d)).alias("y1"))


def in_bounds(strict: bool = True) -> Column:
    """Whether columns x0, y0, x1, y1 are a box in [0, 1]; null coordinates are out of bounds."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    order = (x0 < x1) & (y0 < y1) if strict else (x0 <= x1) & (y0 <= y1)
    return F.coalesce((x0 >= 0) & (y0 >= 0) & (x1 <= 1) & (y1 <= 1) & order, F.lit(False))


def reading_order(blocks: DataFrame, gap: float = 0.05) -> DataFrame:
    """blocks with column_id (from 0) and reading_order (from 1) per (doc_id, page_number).

    By x0, a block starts a new column where it lies more than gap right of everything before; columns are read top to
    bottom. A running maximum gives the gaps, a running sum the islands: two windows over one partitioning, one shuffle.
    """
    page = Window.partitionBy("doc_id", "page_number")
    across = page.orderBy("x0", "y0", "block_ix")
    seen = F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1))
    out = blocks.withColumn("_new", F.coalesce((F.col("x0") - seen > gap).cast("int"), F.lit(0))).withColumn("column_id", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return out.withColumn("reading_order", F.row_number().over(page.orderBy("column_id", "y0", "x0", "block_ix"))).drop("_new")


def group_counts(boxes: DataFrame, distance: float) -> DataFrame:
    """(doc_id, page_number, groups): connected groups of boxes whose gaps in x and y are at most distance.

    Boxes of a page are swept from left to right with union-find, so only boxes that overlap in x are compared.
    """

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None))
        parent = list(range(len(rows)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        active: list[int] = []
        for i, (x0, y0, _, y1) in enumerate(rows):
            active = [j for j in active if x0 - rows[j][2] <= distance]
            for j in active:
                if max(y0 - rows[j][3], rows[j][1] - y1) <= distance:
                    parent[find(i)] = find(j)
            active.append(i)
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "page_number": [pdf["page_number"].iloc[0]], "groups": [len({find(i) for i in range(len(rows))})]})

    return boxes.select("doc_id", "page_number", "x0", "y0", "x1", "y1").groupBy("doc_id", "page_number").applyInPandas(count, "doc_id string, page_number int, groups int")
