from pyspark.sql import functions as F

from quirework.llm import scan_noise as S

BLOCKS = "block_id bigint, doc_id string, source string, page_number int, block_ix int, text string"
LDUS = "ldu_id bigint, doc_id string, ldu_ix int, content string"


def tables(spark):
    plain = [(100 + i, f"p{i}", "s", 1, 0, "The council measured the revenue of the market quietly and the mortgage of the farm") for i in range(12)]
    noisy = [
        (1, "d", "s", 1, 0, "Yearly Report Of Farms 2020"), (2, "d", "s", 1, 1, "The council mea-\nsured the cross-\nborder market"), (3, "d", "s", 1, 2, "The mort-"), (4, "d", "s", 1, 3, "Page 1 of 2"),
        (5, "d", "s", 2, 4, "2  YEARLY REPORT OF FARMS 2020"), (6, "d", "s", 2, 5, "gage of the m@rket in 2O14"), (7, "d", "s", 2, 6, "qiiietly rcvenue ends here"), (8, "d", "s", 2, 7, "[2]"),
        (9, "e", "s", 1, 0, "a cross-\nborder case"), (10, "f", "s", 1, 0, "one cross-\nborder case"), (7, "d", "s", 2, 6, "qiiietly rcvenue ends here"), (None, "d", "s", 2, 9, "x"), (11, "d", "s", 2, 8, None), (12, "d", None, None, None, ""),
    ]
    ldus = [(1, "d", 0, "The council\nmeasured it.\niv"), (2, "d", 1, None), (None, "d", 2, "x-"), (3, "z", 0, "the mar­\nket"), (4, "z", 1, "| a | b |\n|---|---|\n| 1 | 2 |")]
    return spark.createDataFrame(plain + noisy, BLOCKS).withColumn("kind", F.lit("clash")).withColumn("n", F.lit(1)), spark.createDataFrame(ldus, LDUS)


def test_defects(spark):
    got = {tuple(r) for r in S.defects(*tables(spark)).collect()}
    b = lambda i, d: ("block", i, d)
    assert got == {b(1, "furniture"), b(2, "hyphen"), b(3, "hyphen"), b(4, "furniture"), b(5, "furniture"), b(6, "misread"), b(7, "misread"), b(8, "furniture"), ("ldu", 1, "furniture"), ("ldu", 3, "hyphen")}


def test_repaired(spark):
    rows = S.repaired(*tables(spark)).collect()
    got = {(r["record_kind"], r["record_id"]): r["text"] for r in rows}
    assert len(rows) == len(got)
    assert got["block", 2] == "The council measured the cross-border market" and got["block", 3] == "The mortgage"
    assert got["block", 6] == "of the market in 2014" and got["block", 7] == "quietly revenue ends here"
    assert ("block", 4) not in got and ("block", 1) not in got and got["ldu", 1] == "The council measured it." and got["ldu", 3] == "the market"


def test_distance():
    assert S.distance("returned", "retumed") > 1 and S.distance("confirmed", "confirrned") == S.CONFUSED and S.distance("a", "a") == 0
    assert S.distance("market", "markct") == S.CONFUSED and S.distance("market", "marxet") == S.OTHER and S.distance("", "ab") == 2


def test_marks_and_lines():
    for w in ("h@lved", "alon9", "Kale!zora", "certífied", "8raun"):
        assert S.marked(w), w
    for w in ("entries!", "Dr", "3.5", "9.9.7", "m2", "2nd", "Q3", "it's", "1990", "Dolauthor's"):
        assert not S.marked(w), w
    assert [S.number(w) for w in ("2O14", "l997", "$10B", "B2B", "2.5", "10th", "SO")] == ["2O14", "l997", "10B", None, None, None, None]
    assert S.plain("a1on9") == {"along", "aiong"}
    assert S.alike("2  YEARLY REP0RT Of Farms") == S.alike("Yearly Report of Farms   3")


def test_only_what_the_lexicon_proves_is_repaired(spark):
    """Words of other languages, addresses, amounts and codes stay, though they look like misreadings; numbers with letters inside do not."""
    kept = ["El país y los días de paz", "Write to info@example.com about covid19", "A B2B deal of $10B or 1S and 2I", "The 100m and the 10th", "Vitamin B12 for 812 people and 812 more and 812 others"]
    text = [*kept, *[f"In 2014 the council of {w} had 630 members and 21 halls and 15 doors and 108 windows" for w in ("north", "south", "east", "west", "old", "new", "far")], "Counc1l 2O14", "the c0uncil", "630 or 63O or 6O0"]
    rows = [(i, f"d{i}", "s", 1, 0, t) for i, t in enumerate(text)]
    df, none = spark.createDataFrame(rows, BLOCKS), tables(spark)[1].limit(0)
    bad = {r["record_id"] for r in S.defects(df, none).collect()}
    assert bad == {len(text) - 3, len(text) - 2, len(text) - 1}
    got = {r["record_id"]: r["text"] for r in S.repaired(df, none).collect()}
    assert all(got[i] == t for i, t in enumerate(kept))
    assert [got[len(text) - k] for k in (3, 2, 1)] == ["Council 2014", "the council", "630 or 630 or 600"]


def test_words_divided_far_apart_are_completed(spark):
    """Many records of nothing but furniture lie between the halves; places have gaps or are null."""
    rows = [(1, "d", "s", 1, 0, "The protec-"), *[(10 + i, "d", "s", 1, 1 + 70 * i, f"Page {i + 1}") for i in range(9)], (2, "d", "s", 9, 5000, "tion of the hall"), (3, "e", "s", 1, None, "The pro-"), (4, "e", "s", 1, None, "tection"), (5, None, "s", 1, 0, "The pro-"), (6, None, "s", 1, 1, "tection")]
    got = {r["record_id"]: r["text"] for r in S.repaired(spark.createDataFrame(rows, BLOCKS), tables(spark)[1].limit(0)).collect()}
    assert got == {1: "The protection", 2: "of the hall", 3: "The protection", 4: "", 5: "The pro-", 6: "tection"}


def test_empty(spark):
    b, u = tables(spark)
    assert S.defects(b.limit(0), u.limit(0)).count() == 0 and S.repaired(b.limit(0), u.limit(0)).count() == 0


def test_stems_cut_before_repeated_words_are_no_compounds(spark):
    """A stem cut before the same word by accident stays divided, inside a record and at its end; a true compound is none."""
    text = ["The protection of the council and its protection by law"] * 31
    text += [f"the {w} prot-\nection of it" for w in ("full", "wide", "late", "new")]
    text += [f"the {w} prot-\nshare of the {w} market" for w in ("full", "wide", "late", "new")]
    text += [f"a {w} cross-\nborder {v}" for w, v in (("new", "case"), ("wide", "market"), ("late", "deal"))]
    text += ["The wide prot-", "ection is there", "The late cross-", "ing is there", "A new cross-", "border case"]
    rows = [(i, f"d{i // 2}", "s", 1, i % 2, t) for i, t in enumerate(text)]
    got = {r["record_id"] for r in S.defects(spark.createDataFrame(rows, BLOCKS), tables(spark)[1].limit(0)).collect() if r["defect"] == "hyphen"}
    assert got == {i for i, t in enumerate(text) if "prot-" in t or t == "The late cross-"}


def test_two_characters_read_as_one(spark):
    lex = spark.createDataFrame([("returned", 30), ("retumed", 4), ("disclosed", 30), ("disdosed", 2), ("delivered", 30), ("dehvered", 2), ("original", 30), ("ongjnal", 2), ("market", 30), ("marnet", 1)], "word string, n bigint")
    got = {(r["read"], r["true"]): r["cost"] for r in S.corrections(lex).collect()}
    assert got == dict.fromkeys([("retumed", "returned"), ("disdosed", "disclosed"), ("dehvered", "delivered")], S.CONFUSED)
    assert S.distance("returned", "retumed", merged=True) == S.CONFUSED
