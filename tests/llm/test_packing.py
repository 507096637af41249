import os
import random

import pytest
from pyspark.sql import functions as F

from quirework.llm import packing as P


def test_pack_places_all_within_capacity():
    rng = random.Random(1)
    sizes = [min(100, int(rng.expovariate(1 / 25))) for _ in range(3000)]
    where = P.pack(sizes, 100)
    fill = {}
    for s, c in zip(sizes, where, strict=True):
        fill[c] = fill.get(c, 0) + s
    assert max(fill.values()) <= 100 and set(fill) == set(range(len(fill)))
    assert sum(sizes) / (100 * len(fill)) > 0.97
    assert P.pack([], 10) == [] and P.pack([0, 0], 10) == [0, 0] and P.pack([10, 10], 10) == [0, 1]


def plain(sizes, capacity):
    """The rule itself: the least sum of squares of the numbers of open containers per gap."""
    gaps, out = [], []
    for s in sizes:
        best = None
        for g in sorted({x for x in gaps if x >= s}, key=lambda x: x):
            n = [x for x in gaps]
            n[n.index(g)] = g - s
            cost = sum(n.count(x) ** 2 for x in set(n) if x)
            best = min(best, (cost, g)) if best else (cost, g)
        new = [*gaps, capacity - s]
        cost = sum(new.count(x) ** 2 for x in set(new) if x)
        if best and best[0] <= cost:
            gaps[gaps.index(best[1])] -= s
        else:
            gaps.append(capacity - s)
        out.append(sum(x * x for x in [gaps.count(y) for y in set(gaps) if y]))
    return out[-1] if out else 0, len(gaps)


def test_pack_follows_the_rule():
    rng = random.Random(7)
    for _ in range(20):
        sizes = [rng.randint(1, 10) for _ in range(40)]
        where = P.pack(sizes, 10)
        fill = [sum(s for s, c in zip(sizes, where, strict=True) if c == k) for k in range(max(where) + 1)]
        gaps = [10 - f for f in fill]
        assert (sum(gaps.count(y) ** 2 for y in set(gaps) if y), len(gaps)) == plain(sizes, 10)


@pytest.mark.skipif(not os.path.exists(P.VOCABULARY), reason="no tokenizer files here")
def test_documents(spark):
    rows = [(i, "some words of a text " * (i % 40)) for i in range(200)] + [(300, "long " * 900), (301, None), (302, ""), (None, "x"), (300, "long " * 900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("part", F.lit("clash")).withColumn("tokens", F.lit(1))
    got = P.pack_documents(df, 200, shard_rows=50).collect()
    enc = P.encoder(P.VOCABULARY)
    want = {k: len(enc.encode_ordinary(t or "")) for k, t in rows if k is not None}
    have, fill, parts = {}, {}, {}
    for r in got:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["tokens"]
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        parts.setdefault(r["doc_id"], []).append(r["part"])
    assert have == want and max(fill.values()) <= 200
    assert all(sorted(v) == list(range(len(v))) and (len(v) == 1) == (want[k] <= 200) for k, v in parts.items())
    assert P.pack_documents(df.limit(0), 200).count() == 0
