import random
import re

import pytest
from pyspark.sql import functions as F

from quirework.operators import chunking, sections


def words(s):
    return len(s.split())


def pack(items, limit, sep, head=(), last=False, boundary=lambda x: True):
    out, cur = [], list(head)
    n = words(sep.join(cur))
    for x in items:
        if boundary(x) and n + words(x) > limit and len(cur) > len(head):
            out.append(sep.join(cur))
            cur = [cur[-1]] if last else list(head)
            n = words(sep.join(cur))
        cur.append(x)
        n += words(x)
    return [*out, sep.join(cur)] if len(cur) > len(head) else out


def test_packers_against_plain_loops(spark):
    rng = random.Random(5)
    texts = [" ".join(" ".join(rng.choices("abcd", k=rng.randint(1, 9))) + rng.choice(".!?") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    lists = ["\n".join(rng.choice(["- ", "* ", "1. ", "", "  "]) + " ".join(rng.choices("xyz", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 10))) for _ in range(60)]
    tables = ["\n".join(["| a | b |", "|---|---|"][: rng.randint(1, 2)] + [f"| {rng.choice('pqr')} | {i} |" for i in range(rng.randint(0, 12))]) for _ in range(60)]
    rows = [(i, *r) for i, r in enumerate(zip(texts, lists, tables, strict=True))]
    got = spark.createDataFrame(rows, "i int, t string, l string, m string").select("i", chunking.pack_sentences(F.col("t"), 12).alias("t"), chunking.split_list(F.col("l"), 8).alias("l"), chunking.split_table(F.col("m"), 20).alias("m")).collect()
    for r in got:
        t, ls, m = texts[r["i"]], lists[r["i"]], tables[r["i"]]
        assert r["t"] == pack(re.split(r"(?<=[.!?])\s+", t), 12, " ", last=True)
        assert r["l"] == pack(ls.split("\n"), 8, "\n", boundary=lambda x: re.match(r"^(\d+\.|-|\*)\s+", x.strip()))
        lines = m.strip().split("\n")
        assert r["m"] == ([m] if len(lines) < 3 else pack(lines[2:], 20, "\n", head=lines[:2]))


def test_overlap_of_one_sentence(spark):
    text = "This is a simple sentence. This is another sentence that pushes us over the limit."
    got = spark.range(1).select(chunking.pack_sentences(F.lit(text), 10).alias("c")).first()["c"]
    assert len(got) == 2 and words(got[1]) == 15 and got[1].startswith("This is a simple sentence.")


LDU = "ldu_id int, doc_id string, ldu_ix int, content string, chunk_type string, page_refs array<int>, bounding_box struct<x0:double,y0:double,x1:double,y1:double>, parent_section string, token_count int, content_hash string, metadata struct<image_bbox:array<double>,document_name:string>"


def ldu(i, content, kind="text", box=(0.1, 0.1, 0.9, 0.9), pages=(1,), tokens=None, section=None, image=None):
    return (i, "d", i, content, kind, None if pages is None else list(pages), box, section, words(content or "") if tokens is None else tokens, f"h{i}", (image, "n"))


@pytest.mark.parametrize("content, kind, options, rules", [
    ("This is not a table", "table", {}, {"V4"}), ("| a |\n|---|\n| 1 |", "table", {}, set()), ("Plain text starting list", "list", {}, {"V5"}), ("* Item 1", "list", {}, set()),
    ("* This is a (Continued)] fragment", "list", {}, {"V6"}), ("[Context: Item 1 (Continued)]\n* Sub-item", "list", {}, set()), ("x", "text", {"box": (0.9, 0.1, 0.1, 0.9)}, {"V1"}),
    ("x", "text", {"pages": ()}, {"V1"}), ("x", "text", {"pages": None}, {"V1"}), ("x", "text", {"box": None}, {"V1"}), ("a b c", "text", {"tokens": 100}, {"V2"}), ("x", "figure", {}, {"V3"}), ("x", "figure", {"image": [0.1]}, set()),
])
def test_rules(spark, content, kind, options, rules):
    got = chunking.violations(spark.createDataFrame([ldu(1, content, kind, **options)], LDU)).collect()
    assert {r["rule"] for r in got} == rules


def test_references_and_sections(spark):
    rows = [ldu(0, "As seen before, see Table 3 for more."), ldu(1, "Financial Report", "header"), ldu(2, "| table 3 |\n|--|\n| x |", "table"), ldu(3, "see Section 2"), ldu(4, "see Table 9.")]
    df = spark.createDataFrame(rows, LDU)
    got = {r["ldu_id"]: (r["ref_type"], r["ref_value"], r["target"], r["dangling"]) for r in chunking.resolve_references(df).collect()}
    assert got == {0: ("table", "3", 2, False), 3: ("section", "2", None, True), 4: ("table", "9.", None, True)}
    assert [r["current_section"] for r in chunking.open_sections(df).orderBy("ldu_ix").collect()] == [None, "section_1", "section_1", "section_1", "section_1"]


def test_index_tree_and_json(spark):
    rows = [ldu(0, "Intro", "header", section="section_1", pages=(2, 1)), ldu(1, "body", section="section_1"), ldu(2, "inner", section="section_1.1", pages=(4,)), ldu(3, "none")]
    built = sections.build(spark.createDataFrame(rows, LDU))
    got = {r["section_id"]: (r["parent_id"], r["title"], r["page_start"], r["page_end"], r["units"]) for r in built.collect()}
    assert got == {"section_1": (None, "Intro", 1, 2, 2), "section_1.1": ("section_1", "Unknown Section", 4, 4, 1)}
    from quirework.operators import hierarchy

    tree = hierarchy.hierarchy(built.select(F.col("doc_id").alias("grp"), F.col("section_id").alias("node"), F.col("parent_id").alias("parent")))
    text = sections.to_json(tree, built)
    back = {(r["section_id"], r["parent_id"], r["depth"]) for r in sections.from_json(text).collect()}
    assert back == {("section_1", None, 0), ("section_1.1", "section_1", 1)}
    deep = spark.createDataFrame([("d", f"s{i}", f"s{i - 1}" if i else None, f'a "quoted" \\ title {i}' if i % 2 else None) for i in range(70)], "grp string, node string, parent string, title string")
    text = sections.to_json(hierarchy.hierarchy(deep.drop("title")), deep.select(F.col("grp").alias("doc_id"), F.col("node").alias("section_id"), "title"))
    assert {(r["section_id"], r["parent_id"], r["title"], r["depth"]) for r in sections.from_json(text).collect()} == {(r["node"], r["parent"], r["title"], int(r["node"][1:])) for r in deep.collect()}


BLOCKS = "doc_id string, page_number int, block_id bigint, reading_order int, kind string, text string, x0 double, y0 double, x1 double, y1 double"


def built_by_hand(rows, limit):
    """One file at a time, in the order of the definition."""
    out = {}
    for doc in {r[0] for r in rows}:
        units, section, carried = [], None, None
        for _, _, b, _, kind, text, *_ in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[1], ["figure", "table", "text"].index(r[4]), r[3], r[2])):
            content, own = (text or "").strip(), None
            if kind == "figure":
                content = content or "[Figure Content]"
            if not content:
                continue
            typed = kind
            if kind == "text":
                if len(content) < 100 and content.istitle() and not content.endswith("."):
                    typed, section = "header", f"section_{len(units)}"
                if content[0] in "-*" and content[1:2] == " ":
                    typed = "list"
                    if carried:
                        content = f"[Context: {carried} (Continued)]\n{content}"
                    carried = None
            parts = [content]
            if kind != "figure" and len(content.split()) > limit:
                if typed == "list":
                    own = carried = content.split("\n")[0][:50]
                    parts = packed(content.split("\n"), limit)
                    parts = [p if i == 0 else f"[Context: {own} (Continued)]\n{p}" for i, p in enumerate(parts)]
                else:
                    continue
            units += [(doc, len(units) + i, b, typed, section, p) for i, p in enumerate(parts)]
        out[doc] = units
    return {u for x in out.values() for u in x}


def packed(lines, limit):
    out, cur = [], []
    for x in lines:
        if cur and x.strip()[:2] in ("- ", "* ") and sum(len(y.split()) for y in [*cur, x]) > limit:
            out.append("\n".join(cur))
            cur = []
        cur.append(x)
    return [*out, "\n".join(cur)]


def test_units_of_blocks(spark):
    """Order of figures, tables and text, sections by the number of units before, the context of lists that overflow, also from one list to the next."""
    import random

    rng, rows = random.Random(6), []
    for i in range(120):
        kind = rng.choice(["text"] * 6 + ["figure", "table"])
        item = lambda: "- " + " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 4)))
        text = rng.choice([None, " ", "Annual Report", "plain words here", "\n".join(item() for _ in range(rng.randint(1, 4))), "\n".join(item() for _ in range(rng.randint(3, 6)))]) if kind == "text" else rng.choice(["x | y", "", None])
        rows.append((rng.choice("ab"), rng.randint(1, 3), i, rng.randint(0, 5), kind, text, 0.1, 0.1, 0.5, 0.5))
    df = spark.createDataFrame(rows, BLOCKS).withColumn("content", F.lit("clash"))
    got = chunking.build_units(df, 8).collect()
    assert {(r["doc_id"], r["ldu_ix"], r["block_id"], r["chunk_type"], r["parent_section"], r["content"]) for r in got} == built_by_hand(rows, 8)
    assert len(got) == len({(r["doc_id"], r["ldu_ix"]) for r in got}) and any("(Continued)" in r["content"] for r in got)
    assert chunking.build_units(df.limit(0), 8).count() == 0


def test_navigate_and_search(spark):
    s = spark.createDataFrame([("d", "1", "Financial Report", "sum", ["Secret"], ["table"]), ("d", "2", "Audit Findings", None, None, None)], "doc_id string, section_id string, title string, summary string, key_entities array<string>, data_types_present array<string>")
    assert [r["section_id"] for r in sections.navigate(s, "Financial", 1).collect()] == ["1"]
    assert [r["section_id"] for r in sections.search(s, "SECRET").collect()] == ["1"]
