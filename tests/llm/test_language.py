import pytest
from pyspark.sql import functions as F

from quirework.llm import language as L
from quirework.llm import sentences as S


@pytest.fixture(scope="module")
def parts(spark, data):
    docs, samples = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/lang_samples.parquet")
    cuts = S.train_on(docs, samples)
    return cuts, L.train_on(samples, docs, cuts), [(r["language"], r["sample_text"]) for r in samples.orderBy("language", "sample_no").collect()]


def test_held_out_accuracy(parts):
    rows = parts[2]
    model = L.train([r for i, r in enumerate(rows) if i % 6 != 5])
    held = [r for i, r in enumerate(rows) if i % 6 == 5]
    pieces = [(c, t[k : k + 60]) for c, t in held for k in range(0, len(t) - 60, 60)]
    got = model.label([p for _, p in pieces])
    right = sum(g == c for (g, _), (c, _) in zip(got, pieces, strict=True))
    wrong = sum(g not in (c, None) for (g, _), (c, _) in zip(got, pieces, strict=True))
    assert right / len(pieces) > 0.95 and wrong / len(pieces) < 0.03


def test_rejects_what_it_never_saw(parts):
    assert [x for x, _ in parts[1].label(["12 34 -- 5.6", "", "ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺᚾᛁ", "Ἀρχὴ ἥμισυ παντός"])] == [None] * 4


def test_codes(spark):
    cases = {"en": "en", " EN ": "en", "en-GB": "en", "eng": "en", "English": "en", "pt_BR": "pt", "ger": "de", "Deutsch": "de", "zh-CN": "zh", "": None, "und": None, "n/a": None, "unknown": None, None: None, "xx": None}
    rows = spark.createDataFrame([(k,) for k in cases], "l string").select("l", L.language_code(F.col("l")).alias("c")).collect()
    assert {r["l"]: r["c"] for r in rows} == cases


def test_stretches_and_unnamed(spark, parts):
    by = {}
    for c, t in parts[2]:
        by.setdefault(c, t.split(".")[0].strip() + ".")
    rows = [(1, by["en"] + "\n\n" + by["fr"], "f1"), (2, by["de"], "f2"), (3, None, "f3"), (4, "", "f4"), (5, by["ru"], "f5"), (6, by["es"], "f6"), (None, by["es"], "f6")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, file_hash string").withColumn("language", F.lit("clash"))
    profiles = spark.createDataFrame([("f1", "English", "2020"), ("f2", "de-AT", "2021"), ("f2", "fr", "2020"), ("f5", "und", "2020"), (None, "en", "2020")], "doc_id string, language string, profiled_at string").withColumn("profiled_at", F.to_timestamp("profiled_at"))
    got = {tuple(r) for r in L.unnamed_languages(docs, profiles, parts[0], parts[1]).collect()}
    assert got == {(1, "fr"), (5, "ru"), (6, "es")}
    runs = L.stretches(docs, parts[0], parts[1]).orderBy("doc_id", "stretch_ix").collect()
    assert [(r["doc_id"], r["language"]) for r in runs] == [(1, "en"), (1, "fr"), (2, "de"), (5, "ru"), (6, "es")]
    assert all(0 < r["confidence"] <= 1 and r["start"] < r["end"] for r in runs)
    main = {r["doc_id"]: r["languages"] for r in L.document_languages(L.stretches(docs, parts[0], parts[1]), docs).collect()}
    assert main[1] == ["en", "fr"] and main[3] == main[4] == [] and set(main) == {1, 2, 3, 4, 5, 6}
    assert L.unnamed_languages(docs.limit(0), profiles.limit(0), parts[0], parts[1]).count() == 0
