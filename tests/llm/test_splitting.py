import random

import pytest
from pyspark.sql import functions as F

from quirework.llm import splitting as S


def test_round_trip_limits_and_overlap():
    rng = random.Random(1)
    for _ in range(80):
        text = "".join(rng.choice(["word", "no", "longer-token", "。", "第一"]) + rng.choice([" ", " ", " ", ". ", ".\n\n", "\n", "! ", "\n# ", "\n- "]) for _ in range(rng.randint(0, 300)))
        limit, overlap = rng.choice([(20, 5), (50, 0), (7, 6)])
        pieces = S.split(text, limit, overlap)
        tokens = text.split()
        assert "".join(text[p[2] : p[3]] for p in pieces) == (text if tokens else "")
        at = 0
        for i, p in enumerate(pieces):
            own = p[7].split()
            assert len(own) == p[5] <= limit and p[7] == text[p[1] : p[3]]
            assert p[6] == (min(overlap, at) if i else 0)
            assert own == tokens[at - p[6] : at - p[6] + p[5]]
            at += p[5] - p[6]
        assert at == len(tokens)


def test_natural_boundaries():
    text = "One two three. Four five six.\n\nSeven eight nine ten. Eleven twelve."
    assert [p[4] for p in S.split(text, 8, 2)] == ["paragraph", "end"]
    assert [p[4] for p in S.split("a b c. d e f. g h i.", 4, 0)] == ["sentence", "sentence", "end"]
    assert [p[4] for p in S.split("a b c d e f", 4, 0)] == ["word", "end"]
    assert [p[4] for p in S.split("x" * 100, 4, 0, most_chars=10)] == ["character", "character", "end"]
    assert [p[4] for p in S.split("a b " + "x" * 100 + " c. d e", 4, 0, most_chars=10)] == ["word", "character", "character", "sentence", "end"]


def test_text_without_spaces_is_cut_by_characters():
    text = "第一第二" * 25_000
    pieces = S.split(text, 100, 10)
    assert len(pieces) > 4 and max(len(p[7]) for p in pieces) <= 100 * S.MOST_CHARS and "".join(text[p[2] : p[3]] for p in pieces) == text


def test_bad_parameters_and_empty():
    with pytest.raises(ValueError):
        S.split("a", 5, 5)
    assert S.split(None, 5, 1) == [] == S.split(" \n", 5, 1) and len(S.split("a", 5, 1)) == 1


def test_operator(spark):
    rows = [(1, "w " * 30), (1, "w " * 30), (2, "short"), (3, None), (None, "w " * 30), (4, ""), (5, "w " * 20_000)]
    df = spark.createDataFrame(rows, "ldu_id bigint, content string").withColumn("piece", F.lit(0)).withColumn("_key", F.lit("clash"))
    pieces = S.split_oversized(df, 20, 5)
    assert {r["ldu_id"]: r["text"] for r in S.rebuilt(pieces).collect()} == {1: rows[0][1], 5: rows[-1][1]}
    got = pieces.groupBy("ldu_id").count().collect()
    assert {r["ldu_id"]: r["count"] for r in got} == {1: 2, 5: 1334}
    assert S.split_oversized(df.limit(0), 20, 5).count() == 0
