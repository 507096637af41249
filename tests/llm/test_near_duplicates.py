import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import near_duplicates as N

SCHEMA = "ldu_id bigint, content string"


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 30 else None


def collection(seed, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(30, 80))
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            rows.append((i, (" ".join(w)).upper() if rng.random() < 0.2 else ", ".join(w)))
            i += 1
    return rows


@pytest.mark.parametrize("block", [2000, 3])
def test_pairs_against_brute_force(spark, block):
    rows = collection(block) + [(900, None), (901, ""), (902, "too short"), (None, "w1 " * 40), (903, "w1 " * 40), (904, "w1 " * 41)]
    df = spark.createDataFrame(rows + rows[:5], SCHEMA).withColumn("rep", F.lit("clash")).withColumn("t", F.lit(1))
    sets = {k: s for k, t in rows if k is not None and (s := shingles(t))}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    members, links = N.near_duplicates(df, block=block)
    got = [tuple(r) for r in N.all_pairs(members, links).collect()]
    # 903 and 904 have a single shingle: fewer than COMMON, but they are one class.
    assert len(got) == len(set(got)) and set(got) == want
    info = {r["id"]: r for r in N.groups(members, links).collect()}
    for k in sets:
        assert info[k]["links"] == sum(k in p for p in want)
        reach, edge = {k}, True
        while edge:
            edge = {y for p in want for x, y in (p, p[::-1]) if x in reach} - reach
            reach |= edge
        assert info[k]["group_id"] == min(reach)


def test_small_sets_and_hot_shingles(spark):
    """Periodic texts have one to six shingles; one phrase stands in every text, so its shingles are hot with small blocks."""
    rng = random.Random(5)
    rows = [(i, " ".join(([f"p{rng.randrange(3)}" for _ in range(rng.randint(1, 3))] * 40)[: rng.randint(30, 45)] + [rng.choice("xyz") for _ in range(rng.randint(0, 2))])) for i in range(60)]
    phrase = " ".join(f"h{i}" for i in range(30))
    rows += [(100 + i, phrase + " " + " ".join(f"u{rng.randrange(60)}" for _ in range(rng.randint(5, 40)))) for i in range(40)]
    sets = {k: shingles(t) for k, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert min(len(s) for s in sets.values()) <= 2 and len(want) > 100
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (2000, 4):
        got = [tuple(r) for r in N.all_pairs(*N.near_duplicates(df, block=block), share=5).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_fingerprints_never_lie_further_apart_than_the_sets():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ({rng.getrandbits(64) for _ in range(rng.randint(1, 200))} for _ in range(2))
        b |= set(rng.sample(sorted(a), len(a) // 2))
        x, y = N.fingerprints([np.array(sorted(s), np.uint64) for s in (a, b)])
        assert sum(int(i ^ j).bit_count() for i, j in zip(x, y, strict=True)) <= len(a ^ b)


def test_tree_finds_all_within_the_radius():
    rng = random.Random(2)
    tree, items = N.BKTree(), [rng.getrandbits(16) for _ in range(300)]
    for i, x in enumerate(items):
        tree.add(x, (i,))
    for q in items[:40]:
        assert sorted(i for (i,) in tree.within(q, 4)) == [i for i, x in enumerate(items) if (x ^ q).bit_count() <= 4]
    assert list(N.BKTree().within(1, 5)) == []


def test_empty(spark):
    members, links = N.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert N.all_pairs(members, links).count() == 0 and N.groups(members, links).count() == 0
