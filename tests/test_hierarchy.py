import random

import pytest
from pyspark.sql import functions as F

from quirework.operators import hierarchy as H

LINKS = "grp string, node string, parent string"


def walk(rows):
    """Path from the root of every node, None where the way up never ends."""
    up = {(g, n): p for g, n, p in rows}
    out = {}
    for g, n in up:
        path, seen = [n], {n}
        while up[(g, path[0])] is not None and path is not None:
            p = up[(g, path[0])]
            if p in seen:
                path = None
                break
            path.insert(0, p)
            seen.add(p)
        out[(g, n)] = path
    return out


def forest(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for g in "abc":
        names = [f"s{i}" for i in range(n // 3)]
        for i, x in enumerate(names):
            rows.append((g, x, rng.choice([None, *names[:i], *names[:i], *(names if rng.random() < 0.1 else [])])))
    return rows


@pytest.mark.parametrize("limit", [10_000, 5])
def test_against_walking(spark, limit):
    rows = forest(limit, 60)
    tree = H.hierarchy(spark.createDataFrame(rows, LINKS), max_rows=limit)
    got = H.with_paths(tree, stretch=limit).collect()
    want = walk(rows)
    assert len(got) == len(rows)
    below = {k: sum(1 for (g, _), p in want.items() if p and g == k[0] and k[1] in p[:-1]) for k in want}
    by = {(r["grp"], r["node"]): r for r in got}
    for k, path in want.items():
        r = by[k]
        assert r["in_cycle"] == (path is None) and r["path"] == path
        if path:
            assert (r["depth"], r["root"], r["descendants"]) == (len(path) - 1, path[0], below[k])
            assert r["rgt"] - r["lft"] == below[k]
            inside = {n for (g, n), o in by.items() if g == k[0] and o["lft"] is not None and r["lft"] < o["lft"] <= r["rgt"]}
            assert inside == {n for (g, n), p in want.items() if g == k[0] and p and k[1] in p[:-1]}


def test_deep_chain_and_both_ways_agree(spark):
    rows = [("g", f"n{i:04d}", f"n{i - 1:04d}" if i else None) for i in range(9)] + [("g", "x", "y"), ("g", "y", "x"), ("g", "z", "x"), ("g", "self", "self")]
    df = spark.createDataFrame(rows, LINKS)
    a, b = ({tuple(map(str, r)) for r in H.hierarchy(df, m).collect()} for m in (1000, 3))
    assert a == b and sum("True" in r for r in a) == 4


def test_current_links(spark):
    schema = "doc_id string, section_id string, parent_id string, child_sections array<string>, ingested_at timestamp"
    rows = [
        ("d", "a", None, ["b"], None), ("d", "b", None, None, None), ("d", "c", " ", [], None), ("d", "e", "absent", [], None), ("d", "f", "a", ["a"], None), ("d", "f", "a", ["a"], None),
        ("e", "b", None, ["nowhere"], None), (None, "q", None, None, None), ("d", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("node", F.lit("clash"))
    got = {tuple(r) for r in H.current_links(df).select("grp", "node", "parent").collect()}
    assert got == {("d", "a", "f"), ("d", "b", "a"), ("d", "c", None), ("d", "e", None), ("d", "f", "a"), ("e", "b", None)}
    for way in (H.hierarchy(H.current_links(df)), H.sections_tree(df), H.sections_tree(df, 2)):
        tree = {(r["grp"], r["node"]): r["in_cycle"] for r in way.collect()}
        assert tree == {("d", "a"): True, ("d", "b"): True, ("d", "c"): False, ("d", "e"): False, ("d", "f"): True, ("e", "b"): False}


def test_newest_row_holds(spark):
    schema = "doc_id string, section_id string, parent_id string, child_sections array<string>, ingested_at string"
    rows = [("d", "a", "b", ["b"], "2020-01-01"), ("d", "a", None, [], "2021-01-01"), ("d", "b", None, [], "2020-01-01")]
    df = spark.createDataFrame(rows, schema).withColumn("ingested_at", F.to_timestamp("ingested_at"))
    assert {tuple(r) for r in H.current_links(df).collect()} == {("d", "a", None), ("d", "b", None)}


def test_empty(spark):
    empty = spark.createDataFrame([], LINKS)
    assert H.hierarchy(empty).count() == 0 and H.hierarchy(empty, 0).count() == 0
    assert H.descendants(H.hierarchy(empty)).count() == 0 and H.with_paths(H.hierarchy(empty)).count() == 0


def test_descendants(spark):
    rows = [("g", "a", None), ("g", "b", "a"), ("g", "c", "b")]
    got = {tuple(r) for r in H.descendants(H.hierarchy(spark.createDataFrame(rows, LINKS))).collect()}
    assert got == {("g", "a", "b", 1), ("g", "a", "c", 2), ("g", "b", "c", 1)}
    for stretch in (1, 2, 50_000):
        assert {tuple(r) for r in H.descendants(H.hierarchy(spark.createDataFrame(rows, LINKS)), stretch).collect()} == got


def test_sums_over_subtrees(spark):
    rows = forest(4, 90)
    df = spark.createDataFrame(rows, LINKS)
    tree = H.hierarchy(df).withColumn("v", F.length("node").cast("long")).withColumn("total", F.lit("clash"))
    want = {(g, n): sum(len(m) for (h, m), q in walk(rows).items() if h == g and q and n in q) for (g, n), p in walk(rows).items() if p}
    for stretch in (3, 50_000):
        assert {(r["grp"], r["node"]): r["total"] for r in H.subtree_sums(tree, "v", stretch).collect()} == want


def test_chain_of_a_hundred_thousand(spark):
    """Ends in a few rounds, with numbers that fit; a cycle of the same length is found too."""
    n = 100_000
    i = spark.range(n).select(F.lit("g").alias("grp"), F.format_string("n%d", "id").alias("node"), F.when(F.col("id") > 0, F.format_string("n%d", F.col("id") - 1)).alias("parent"), "id")
    r = H.hierarchy(i.select("grp", "node", "parent")).agg(F.max("depth"), F.sum("depth"), F.sum("descendants"), F.count_if(F.col("lft") == F.col("depth") + 1), F.count_if(F.col("rgt") == n), F.count_if("in_cycle")).first()
    assert tuple(r) == (n - 1, n * (n - 1) // 2, n * (n - 1) // 2, n, n, 0)
    ring = i.select("grp", "node", F.coalesce("parent", F.lit(f"n{n - 1}")).alias("parent"))
    assert H.hierarchy(ring).filter("in_cycle").count() == n
