import random

import pytest
from pyspark.sql import functions as F

from quirework.llm import sentences as S

SUBJECTS = ["The council", "A bank", "Our office", "The court"]
THAI = ["สภา", "ธนาคาร", "เทศบาล", "ศาล"]


def corpus(seed, n=500):
    """Texts of known sentences: (text, starts)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text, starts, thai = "", [], rng.random() < 0.3
        for p in range(rng.randint(2, 4)):
            text += "\n\n" if p else ""
            for q in range(rng.randint(1, 4)):
                text += " " if q else ""
                starts.append(len(text))
                if thai:
                    text += rng.choice(THAI) + rng.choice(["แก้ไขงบประมาณ", "ระงับภาษี"]) + rng.choice(["", " เมื่อวันที่ 9 พ.ค. 2000", " ก่อนปิดบัญชี", " ร่วมกับ ดร. เกเล"])
                else:
                    text += rng.choice(SUBJECTS) + rng.choice([" met", " met again", " paid 3.5 units", " met Dr. Smith on 3 May", " paid 3.5 units under No. 7", ' wrote: "It was kept. Nobody came."', " moved, e.g. for review", " asked Mr. Jones"])
                    text += "" if text.endswith('"') else rng.choice([".", ".", "?", "!"])
        out.append((text, starts))
    return out


@pytest.fixture(scope="module")
def model():
    return S.train([t for t, _ in corpus(1)])


def test_held_out_accuracy(model):
    hit = found = true = 0
    for text, starts in corpus(2, 200):
        got = set(model.starts(text))
        hit, found, true = hit + len(got & set(starts)), found + len(got), true + len(starts)
    assert hit / found > 0.97 and hit / true > 0.97


def test_lists_headings_and_quotations(model):
    text = "A Heading of It\n\n* First item\n2. Second item\n\nThe council wrote: \"It was kept. Nobody came.\" A bank paid 3.5 units under No. 7."
    assert [text[i:].split()[0] for i in model.starts(text)] == ["A", "*", "2.", "The", "A"]


def test_odd_texts(model):
    assert model.starts(None) == model.starts("") == model.starts(" \n\n ") == []
    assert model.starts("  x") == [2] and model.starts("😀 ok.\n\n\nmore") == [0, 8]
    long = "The council met. " * 5000
    assert len(model.starts(long)) == 5000


def test_operator(spark, model):
    rows = [(1, "The council met Dr. Smith on 3 May. A bank asked Mr. Jones."), (2, None), (3, ""), (None, "x"), (4, "one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("sentence_start", F.lit("clash"))
    assert sorted(tuple(r) for r in S.sentence_starts(df, model).collect()) == [(1, 0), (1, 36), (4, 0)]
    got = S.sentences(df, model).orderBy("doc_id", "sentence_ix").collect()
    assert [(r["doc_id"], r["sentence"]) for r in got] == [(1, "The council met Dr. Smith on 3 May."), (1, "A bank asked Mr. Jones."), (4, "one")]
    empty = df.limit(0)
    assert S.sentence_starts(empty, S.train_on(empty)).count() == 0


def test_sample_is_the_same_in_any_order_of_rows(spark):
    rows = [(i, f"{'ไทย' if i % 3 == 0 else 'Text'} number {i}") for i in range(60)]
    one, two = (S.drawn(spark.createDataFrame(r, "doc_id bigint, text string").repartition(n), sample=10, sample_script=4) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert one == two and 10 <= len(one) <= 18 and sum("ไทย" in t for t in one) >= 4
    samples = spark.createDataFrame([("en", f"a{i}") for i in range(30)] + [("th", "b"), (None, "c"), ("th", None)], "language string, sample_text string")
    few = S.labelled(samples, most=5)
    assert len(few) == 6 and ("th", "b") in few and few == S.labelled(samples.orderBy(F.desc("sample_text")), most=5)


def test_terminators_are_stripped_where_a_script_writes_none():
    assert S.stripped("ไทย ไทย. ไทย 3.5 ไทย! ") == "ไทย ไทย ไทย 3.5 ไทย "
    assert S.stripped("Text. More ไทย.") == "Text. More ไทย."
