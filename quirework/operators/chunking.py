"""Blocks to logical document units: types, packing, sections, references, validation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import text as T
from quirework.operators.geometry import in_bounds
from quirework.session import materialize

MAX_TOKENS = 800
# Patterns of references and of sentences about a table.
REFERENCE = r"(?i)(?:see\s+|as\s+shown\s+in\s+)(table|figure|section)\s+([a-zA-Z0-9.\-]+)"
TABLE_RELATION = r"(?i)(?:as\s+shown\s+in\s+table|table)\s+([a-zA-Z0-9.\-]+)\s+(?:shows|illustrates|demonstrates|details)"
_FOLD = "chunks array<string>, cur array<string>, n int"


def block_type(content: Column) -> Column:
    """header, list or text; a titled list item is a list (though it opens a section, see open_sections)."""
    return F.when(T.is_list(content), "list").when(T.is_header(content), "header").otherwise("text")


def _fold(items: Column, limit: int, head: Column | None, boundary, sep: str, carry_last: bool) -> Column:
    """Greedy packing of an array of strings into chunks."""
    empty = F.array().cast("array<string>")
    base = head if head is not None else empty
    base_n = T.token_count(F.array_join(base, sep)) if head is not None else F.lit(0)
    start = F.struct(empty.alias("chunks"), base.alias("cur"), base_n.alias("n"))
    filled = (lambda a: F.size(a["cur"]) > F.size(base)) if head is not None else (lambda a: F.size(a["cur"]) > 0)

    def step(a: Column, x: Column) -> Column:
        n = T.token_count(x)
        full = boundary(x) & (a["n"] + n > limit) & filled(a)
        kept = F.slice(a["cur"], -1, 1) if carry_last else base
        kept_n = T.token_count(F.array_join(kept, sep)) if carry_last or head is not None else F.lit(0)
        return F.when(full, F.struct(F.concat(a["chunks"], F.array(F.array_join(a["cur"], sep))).alias("chunks"), F.concat(kept, F.array(x)).alias("cur"), (kept_n + n).alias("n"))).otherwise(F.struct(a["chunks"].alias("chunks"), F.concat(a["cur"], F.array(x)).alias("cur"), (a["n"] + n).alias("n")))

    return F.aggregate(items, start, step, lambda a: F.when(filled(a), F.concat(a["chunks"], F.array(F.array_join(a["cur"], sep)))).otherwise(a["chunks"]))


def pack_sentences(text: Column, limit: int) -> Column:
    """Sentences packed up to limit tokens; each chunk but the first repeats the last sentence of the one before. A lone long sentence stays whole."""
    return _fold(F.split(text, r"(?<=[.!?])\s+"), limit, None, lambda x: F.lit(True), " ", True)


def split_table(markdown: Column, limit: int) -> Column:
    """Rows of a markdown table packed under its two header lines; fewer than three lines stay whole."""
    lines = F.split(T.strip(markdown), "\n")
    packed = _fold(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), limit, F.slice(lines, 1, 2), lambda x: F.lit(True), "\n", False)
    return F.when(F.size(lines) < 3, F.array(markdown)).otherwise(packed)


def split_list(text: Column, limit: int) -> Column:
    """A list cut before items only; the lines that go on an item stay with it."""
    return _fold(F.split(text, "\n"), limit, None, lambda x: T.is_list(T.strip(x)), "\n", False)


def chunks(ldus: DataFrame, limit: int = MAX_TOKENS, key: str = "ldu_id") -> DataFrame:
    """(key, chunk_type, sub_ix, content, token_count): every unit within limit as it is, larger ones cut by their type. No shuffle. Null content gives no chunk."""
    c, kind = F.col("content"), F.col("chunk_type")
    many = F.when(kind == "table", split_table(c, limit)).when(kind == "list", split_list(c, limit)).otherwise(pack_sentences(c, limit))
    parts = F.when(T.token_count(c) > limit, many).otherwise(F.array(c))
    return ldus.filter("content IS NOT NULL").select(key, "chunk_type", F.posexplode(parts).alias("sub_ix", "content")).withColumn("token_count", T.token_count(F.col("content")))


def _context(prefix: Column) -> Column:
    """The line that goes on a list which overflowed; null for a null prefix."""
    return F.concat(F.lit("[Context: "), prefix, F.lit(" (Continued)]"))


_ASCII_TOKEN = re.compile(r"[^ \t\n\x0b\f\r]+")


def _carry(limit: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, prefix = None, None
        for pdf in it:
            rows = []
            for d, block, n, line in zip(pdf["doc_id"], pdf["block_id"], pdf["n"], pdf["line"], strict=True):
                if d != doc:
                    doc, prefix = d, None
                carried, prefix = prefix, None
                if carried is not None:
                    line = f"[Context: {carried} (Continued)]"
                    n += len(_ASCII_TOKEN.findall(line))
                if n > limit:
                    prefix = line[:50]
                rows.append((d, block, carried, prefix))
            yield pd.DataFrame(rows, columns=["doc_id", "block_id", "carried", "own"])

    return run


def build_units(blocks: DataFrame, limit: int = MAX_TOKENS, tokenizer: Callable[[Column], Column] = T.token_count) -> DataFrame:
    """(doc_id, ldu_ix, block_id, sub_ix, chunk_type, parent_section, page_number, content, token_count, content_hash, x0, y0, x1, y1) of blocks (doc_id, page_number, block_id, reading_order, kind, text, box).

    Page by page come figures, tables, text by reading order (ties by block_id); blank text and tables give no unit, a blank figure "[Figure Content]". A header
    opens section_<number of units before it>. What exceeds limit tokens is cut by its type (figures never); the later parts of a list carry a line with the first 50 characters of its
    first line, and so does the next list of the file. tokenizer counts the units' token_count; cuts go by white space. Rows without doc_id have no file and are left out.
    Running numbers go by pages, then over the pages, and only the lists of a file go through one task, as a stream.
    """
    own_columns = [c for c in ("doc_id", "page_number", "block_id", "reading_order", "kind", "text", "x0", "y0", "x1", "y1")]
    b = blocks.select(*own_columns).filter("doc_id IS NOT NULL").withColumn("content", T.strip(F.coalesce("text", F.lit("")))).drop("text")
    b = b.withColumn("content", F.when((F.col("kind") == "figure") & (F.col("content") == ""), "[Figure Content]").otherwise(F.col("content"))).filter("content <> ''")
    c, kind = F.col("content"), F.col("kind")
    b = b.withColumn("chunk_type", F.when(kind == "text", block_type(c)).otherwise(kind)).withColumn("opens", F.coalesce((kind == "text") & T.is_header(c), F.lit(False)))
    b = b.withColumn("at", F.struct(F.when(kind == "figure", 0).when(kind == "table", 1).otherwise(2).alias("k"), "reading_order", "block_id"))
    lists = b.filter("chunk_type = 'list'").select("doc_id", "block_id", "page_number", "at", T.token_count(c).alias("n"), F.left(F.split(c, "\n")[0], F.lit(50)).alias("line"))
    carried = lists.repartition("doc_id").sortWithinPartitions("doc_id", "page_number", "at").select("doc_id", "block_id", "n", "line").mapInPandas(_carry(limit), f"doc_id string, block_id {blocks.schema['block_id'].dataType.simpleString()}, carried string, own string")
    b = b.join(carried, ["doc_id", "block_id"], "left").withColumn("content", F.coalesce(F.concat(_context(F.col("carried")), F.lit("\n"), c), c))
    listed = F.transform(split_list(c, limit), lambda x, i: F.when(i > 0, F.coalesce(F.concat(_context(F.col("own")), F.lit("\n"), x), x)).otherwise(x))
    many = F.when(F.col("chunk_type") == "table", split_table(c, limit)).when(F.col("chunk_type") == "list", listed).otherwise(pack_sentences(c, limit))
    b = materialize(b.withColumn("parts", F.when((F.col("chunk_type") != "figure") & (T.token_count(c) > limit), many).otherwise(F.array(c))).drop("content", "carried", "own"), "parts")
    page = Window.partitionBy("doc_id", "page_number").orderBy("at")
    upto = lambda w, end: w.rowsBetween(Window.unboundedPreceding, end)
    pages = b.groupBy("doc_id", "page_number").agg(F.sum(F.size("parts")).alias("units"))
    pages = pages.select("doc_id", "page_number", F.coalesce(F.sum("units").over(upto(Window.partitionBy("doc_id").orderBy("page_number"), -1)), F.lit(0)).alias("base"))
    b = b.withColumn("before", F.coalesce(F.sum(F.size("parts")).over(upto(page, -1)), F.lit(0))).join(pages, ["doc_id", "page_number"]).withColumn("first", F.col("before") + F.col("base"))
    opened = F.when(F.col("opens"), F.concat(F.lit("section_"), F.col("first")))
    heads = b.groupBy("doc_id", "page_number").agg(F.max_by(opened, F.when(F.col("opens"), F.col("at"))).alias("last"))
    heads = heads.select("doc_id", "page_number", F.last("last", ignorenulls=True).over(upto(Window.partitionBy("doc_id").orderBy("page_number"), -1)).alias("earlier"))
    b = b.withColumn("here", F.last(opened, ignorenulls=True).over(upto(page, 0))).join(heads, ["doc_id", "page_number"]).withColumn("parent_section", F.coalesce("here", "earlier"))
    u = b.select("doc_id", "block_id", "chunk_type", "parent_section", "page_number", "x0", "y0", "x1", "y1", "first", F.posexplode("parts").alias("sub_ix", "content"))
    box = [F.col(x) for x in ("x0", "y0", "x1", "y1")]
    return u.select("doc_id", (F.col("first") + F.col("sub_ix")).cast("int").alias("ldu_ix"), "block_id", "sub_ix", "chunk_type", "parent_section", "page_number", "content", tokenizer(c).alias("token_count"), T.ldu_hash(c, box, F.col("chunk_type")).alias("content_hash"), *box)


def open_sections(ldus: DataFrame) -> DataFrame:
    """ldus with current_section: section_<ldu_ix> of the last header at or before each unit of the file, null before the first."""
    w = Window.partitionBy("doc_id").orderBy("ldu_ix").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(T.is_header(F.col("content")), F.concat(F.lit("section_"), F.col("ldu_ix")))
    return ldus.withColumn("current_section", F.last(opens, ignorenulls=True).over(w))


def list_context(ldus: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """ldus of type list with carried: the first 50 characters of the list before, if that one overflowed."""
    before = Window.partitionBy("doc_id").orderBy("ldu_ix")
    over = F.when(T.token_count(F.col("content")) > limit, F.left(F.split("content", "\n")[0], F.lit(50)))
    return ldus.filter("chunk_type = 'list'").withColumn("carried", F.lag(over).over(before))


def references(ldus: DataFrame, key: str = "ldu_id") -> DataFrame:
    """(key, doc_id, ldu_ix, ref_type, ref_value, related_table_id) of units with a reference or a sentence about a table."""
    kind, value, table = F.lower(F.regexp_extract("content", REFERENCE, 1)), F.lower(F.regexp_extract("content", REFERENCE, 2)), F.lower(F.regexp_extract("content", TABLE_RELATION, 1))
    r = ldus.select(key, "doc_id", "ldu_ix", F.nullif(kind, F.lit("")).alias("ref_type"), F.nullif(value, F.lit("")).alias("ref_value"), F.when(table != "", F.concat(F.lit("table_"), table)).alias("related_table_id"))
    return r.filter("ref_type IS NOT NULL OR related_table_id IS NOT NULL")


def resolve_references(ldus: DataFrame, key: str = "ldu_id") -> DataFrame:
    """references with target: the first unit of that type in the file whose text contains type and value; null (dangling) if there is none.

    The join is on file and type, the containment is its condition; only units of the referred types are shuffled.
    """
    refs = references(ldus, key).filter("ref_type IS NOT NULL").withColumn("needle", F.concat_ws(" ", "ref_type", "ref_value"))
    targets = ldus.filter(F.col("chunk_type").isin("table", "figure")).select(F.col("doc_id").alias("td"), F.col("chunk_type").alias("tt"), F.col(key).alias("tk"), F.col("ldu_ix").alias("ti"), F.lower("content").alias("tc"))
    hit = refs.join(targets, (F.col("doc_id") == F.col("td")) & (F.col("ref_type") == F.col("tt")) & F.col("tc").contains(F.col("needle"))).groupBy(key).agg(F.min_by("tk", F.struct("ti", "tk")).alias("target"))
    return refs.join(hit, key, "left").select(key, "doc_id", "ref_type", "ref_value", "target", F.col("target").isNull().alias("dangling"))


def violations(ldus: DataFrame, key: str = "ldu_id") -> DataFrame:
    """(key, rule), one row a broken rule: V1 box or pages, V2 token count, V3 figure without image box, V4 table without bars, V5 list without marker, V6 continuation without context."""
    box = ldus.select("*", *[F.col(f"bounding_box.{c}").alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    flat = box.select("*").withColumnsRenamed({f"_{c}": c for c in ("x0", "y0", "x1", "y1")}) if not {"x0", "y0", "x1", "y1"} & set(ldus.columns) else box
    c, kind = F.col("content"), F.col("chunk_type")
    rules = [
        ("V1", ~in_bounds(strict=False) | F.col("page_refs").isNull() | (F.size("page_refs") <= 0)),
        ("V2", ~F.col("token_count").eqNullSafe(T.token_count(c))),
        ("V3", (kind == "figure") & F.col("metadata.image_bbox").isNull()),
        ("V4", (kind == "table") & (T.strip(c) != "") & ~c.contains("|")),
        ("V5", (kind == "list") & ~T.strip(c).rlike(r"^(\d+\.|-|\*|\[Context:)")),
        ("V6", c.contains("(Continued)]") & ~c.contains("[Context:")),
    ]
    return flat.select(key, F.explode(F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in rules]), lambda x: x.isNotNull())).alias("rule"))
