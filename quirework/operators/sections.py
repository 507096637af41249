"""Section index: built from units, navigated, searched, nested as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import text as T
from quirework.session import materialize


def parent_of(section_id: Column) -> Column:
    """section_1.2 -> section_1; null for an id without a point."""
    tail = F.regexp_extract(section_id, r"([^_]*)$", 1)
    return F.when(F.instr(section_id, ".") > 0, F.concat(F.lit("section_"), F.regexp_extract(tail, r"^(.*)\.[^.]*$", 1)))


def build(ldus: DataFrame, summaries: DataFrame | None = None, without: str | None = None, text_limit: int = 10_000) -> DataFrame:
    """(doc_id, section_id, parent_id, title, page_start, page_end, data_types_present, units, content, summary).

    Units without a section are left out, or go to the section named `without`. The title is the first header's text, else
    "Unknown Section"; a parent that has no units makes a root. summaries: (doc_id, section_id, summary).
    """
    u = ldus.withColumn("section_id", F.coalesce(F.nullif("parent_section", F.lit("")), F.lit(without)) if without else F.nullif("parent_section", F.lit(""))).filter("section_id IS NOT NULL AND doc_id IS NOT NULL")
    # A running length first, so that no more of a section is gathered than its text may hold.
    before = F.sum(F.length("content") + 1).over(Window.partitionBy("doc_id", "section_id").orderBy("ldu_ix", "ldu_id").rowsBetween(Window.unboundedPreceding, -1))
    u = u.select("doc_id", "section_id", "ldu_ix", "ldu_id", "content", "chunk_type", "page_refs", F.coalesce(before, F.lit(0)).alias("before"))
    header = F.col("chunk_type") == "header"
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("before") < text_limit, F.struct("ldu_ix", "ldu_id", "content")))), lambda x: x["content"]), "\n")
    g = u.groupBy("doc_id", "section_id").agg(F.min_by(F.when(header, F.col("content")), F.when(header, F.struct("ldu_ix", "ldu_id"))).alias("title"), F.min(F.array_min("page_refs")).alias("page_start"), F.max(F.array_max("page_refs")).alias("page_end"), F.sort_array(F.collect_set("chunk_type")).alias("data_types_present"), F.count("*").alias("units"), F.left(text, F.lit(text_limit)).alias("content"))
    g = g.withColumn("title", F.coalesce("title", F.lit("Unknown Section"))).withColumn("named", parent_of(F.col("section_id")))
    have = g.select("doc_id", F.col("section_id").alias("named"), F.col("section_id").alias("parent_id"))
    g = g.join(have, ["doc_id", "named"], "left").drop("named")
    if summaries is None:
        return g.withColumn("summary", F.lit("Summary unavailable."))
    return g.join(summaries.select("doc_id", "section_id", "summary"), ["doc_id", "section_id"], "left").withColumn("summary", F.coalesce("summary", F.lit("Summary unavailable.")))


def summarize(sections: DataFrame, sentences: int = 2) -> DataFrame:
    """The default summary provider: the first sentences of content."""
    return sections.withColumn("summary", F.array_join(F.slice(F.split("content", r"(?<=[.!?])\s+"), 1, sentences), " "))


def _set(c: Column) -> Column:
    return F.array_distinct(T.tokens(F.lower(F.coalesce(c, F.lit("")))))


def navigate(sections: DataFrame, query: str, k: int = 3) -> DataFrame:
    """The k sections of the best score: 2 a word shared with the title, 1 with the summary, 1.5 a key entity; ties by doc_id, section_id. TakeOrdered, no full sort."""
    q = F.array(*[F.lit(w) for w in sorted(set(query.lower().split()))])
    entities = F.array_distinct(F.transform(F.coalesce("key_entities", F.array().cast("array<string>")), F.lower))
    score = 2.0 * F.size(F.array_intersect(_set(F.col("title")), q)) + F.size(F.array_intersect(_set(F.col("summary")), q)) + 1.5 * F.size(F.array_intersect(entities, q))
    return sections.withColumn("score", score.cast("double")).orderBy(F.desc("score"), "doc_id", "section_id").limit(k)


def search(sections: DataFrame, entity: str) -> DataFrame:
    """Sections that name the entity among key entities or data types, in any case."""
    e = entity.lower()
    return sections.filter(F.exists("key_entities", lambda x: F.lower(x) == e) | F.exists("data_types_present", lambda x: F.lower(x) == e))


def current(sections: DataFrame) -> DataFrame:
    """The row of the greatest ingested_at of every doc_id and section_id."""
    names = [c for c in sections.columns if c not in ("doc_id", "section_id")]
    return sections.filter("doc_id IS NOT NULL AND section_id IS NOT NULL").groupBy("doc_id", "section_id").agg(F.max_by(F.struct(*names), F.struct(F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0))), F.xxhash64("title", "parent_id", "child_sections"))).alias("r")).select("doc_id", "section_id", "r.*")


def to_json(tree: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, json): the sections of each file nested under their parents, from hierarchy rows (grp, node, depth, lft, in_cycle) and titles (doc_id, section_id, title). Rows in a cycle are left out.

    Each node is written once, in preorder; the difference of two depths tells how many brackets close between them. A file's tree is one value, so its rows come together.
    """
    t = titles.select(F.col("doc_id").alias("grp"), F.col("section_id").alias("node"), "title")
    item = F.regexp_replace(F.to_json(F.struct(F.col("node").alias("section_id"), "title"), {"ignoreNullFields": "false"}), r"\}$", ',"child_sections":[')
    rows = tree.filter("NOT in_cycle").join(t, ["grp", "node"], "left").groupBy(F.col("grp").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("lft", "depth", item.alias("item")))).alias("r"))
    close = lambda n: F.repeat(F.lit("]}"), n)
    between = lambda x, i: F.when(i == 0, "").when(x["depth"] > F.col("r")[i - 1]["depth"], "").otherwise(F.concat(close(F.col("r")[i - 1]["depth"] - x["depth"] + 1), F.lit(",")))
    text = F.array_join(F.transform("r", lambda x, i: F.concat(between(x, i), x["item"])), "")
    return rows.select("doc_id", F.concat(F.lit("["), text, close(F.element_at("r", -1)["depth"] + 1), F.lit("]")).alias("json"))


def from_json(trees: DataFrame, every: int = 8) -> DataFrame:
    """(doc_id, section_id, parent_id, title, depth) of nested JSON, a level at a time to the deepest; what is done is written to the shared folder every few levels."""
    item = "array<struct<section_id:string,title:string,child_sections:string>>"
    front = trees.select("doc_id", F.explode(F.from_json("json", item)).alias("s"), F.lit(None).cast("string").alias("parent_id"))
    out, depth = None, 0
    while True:
        rows = front.select("doc_id", "s.section_id", "parent_id", "s.title", F.lit(depth).alias("depth"))
        out = rows if out is None else out.unionByName(rows)
        front = front.filter("s.child_sections <> '[]'").select("doc_id", F.explode(F.from_json("s.child_sections", item)).alias("c"), F.col("s.section_id").alias("parent_id")).select("doc_id", F.col("c").alias("s"), "parent_id")
        depth += 1
        if depth % every == 0:
            front, out = materialize(front, "levels"), materialize(out, "levels")
        if front.isEmpty():
            return out


def embedding_text(sections: DataFrame) -> DataFrame:
    return sections.withColumn("embedding_text", T.sql_embedding_text(F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))


def first_rows(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in order (keep-first, also the upsert when order is newest first)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")
