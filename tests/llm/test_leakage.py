import random

import pytest
from pyspark.sql import functions as F

from quirework.llm import leakage as L

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, item_text string"


def holds(text, item, n=12):
    a, b = L.words(text or ""), L.words(item or "")
    runs = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return any(tuple(a[i : i + n]) in runs for i in range(len(a) - n + 1))


@pytest.mark.parametrize("block", [5000, 3])
def test_against_brute_force(spark, block):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([5, 11, 12, 40])))) for i in range(20)] + [(98, None), (99, ""), (None, "a b"), (0, None)]
    docs = []
    for d in range(150):
        src = rng.choice(items[:20])[1].split()
        n = rng.choice([0, 11, 12, 13, 40])
        at = rng.randint(0, max(0, len(src) - n))
        part = src[at : at + n]
        docs.append((d, " ".join(rng.choices(words, k=5)) + "; " + ",\n".join(part).upper() + "! " + " ".join(rng.choices(words, k=6))))
    docs += [(900, None), (901, ""), (902, " ".join(items[3][1].split() * 4000)), (None, items[3][1])]
    want = {(d, i) for d, t in docs for i, x in items if d is not None and i is not None and holds(t, x)}
    df = spark.createDataFrame(docs + docs[:3], DOCS).withColumn("item_id", F.lit("clash"))
    got = [tuple(r) for r in L.leaked_items(df, spark.createDataFrame(items, ITEMS), items_a_block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


@pytest.mark.parametrize("docs, items", [([], [(1, "a " * 20)]), ([(1, "a " * 20)], []), ([], [])])
def test_empty(spark, docs, items):
    for block in (5000, 0):
        assert L.leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), items_a_block=block).count() == 0


def test_more_items_than_a_block(spark):
    items = [(i, " ".join(f"x{i}y{j}" for j in range(15))) for i in range(5)]
    got = L.leaked_items(spark.createDataFrame([(7, items[4][1]), (8, items[0][1])], DOCS), spark.createDataFrame(items, ITEMS), items_a_block=2)
    assert {tuple(r) for r in got.collect()} == {(7, 4), (8, 0)}
