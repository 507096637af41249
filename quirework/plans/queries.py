"""Named queries of the core operators. The SQL that says the same is in quirework.plans.oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import embedding
from quirework.functions import text as T
from quirework.operators import agent, chunking, extraction, facts, geometry, hierarchy, reports, retrieval, sections, triage, units
from quirework.plans.oracle import ORACLE, SPLIT_TOKENS
from quirework.session import materialize, table
from quirework.sources import tables as sources
from quirework.streaming import ledger

EXTENT = 25.0

_Q: dict = {}


def _query(f):
    _Q[f.__name__] = f
    return f


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_blocks").dropDuplicates(["block_id"])


def _ldus(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    t = table(spark, d, "ldus")
    keep = list(dict.fromkeys(["ldu_id", *columns])) if columns else t.columns
    rest = [c for c in keep if c != "ldu_id"]
    return t.groupBy("ldu_id").agg(F.max_by(F.struct(*rest), "ingested_at").alias("r")).select("ldu_id", "r.*")


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "profiles").groupBy("doc_id").agg(F.max_by(F.struct("file_name", "file_hash", "origin_type", "layout_type", "page_count"), "profiled_at").alias("r")).select("doc_id", "r.*")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as page boxes: vision blocks are images, blocks with a bar are vectors as well, all others characters."""
    b = _blocks(spark, d)
    kind = F.when(F.col("source_strategy") == "vision", "image").when(F.col("text").contains("|"), "vector").otherwise("char")
    return b.select("doc_id", F.col("page_number").alias("page_ix"), kind.alias("kind"), "x0", "y0", "x1", "y1", F.when(F.col("source_strategy") != "vision", F.length("text")).alias("n_chars"), F.when(F.col("source_strategy") != "vision", F.round(F.col("y1") - F.col("y0"), 2)).alias("font"))


# Problems 2 and 6


@_query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of facts that state the same quantity."""
    return units.equal_facts(units.common_quantities(table(spark, d, "facts"), table(spark, d, "common_units"))).distinct()


@_query
def p2_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Every fact as a number in its common unit, with its period in one form."""
    q = units.common_quantities(table(spark, d, "facts"), table(spark, d, "common_units"))
    return q.select("id", "entity", "period", "quantity", "common_unit", "common_value")


@_query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Sections caught in a cycle or below one."""
    return _tree(spark, d).filter("in_cycle").select(F.col("grp").alias("doc_id"), F.col("node").alias("section_id")).distinct()


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.sections_tree(table(spark, d, "sections"))


@_query
def p6_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root, preorder range and number of descendants of every section."""
    return hierarchy.with_paths(materialize(_tree(spark, d), "tree")).withColumn("path", F.array_join("path", "/")).withColumnsRenamed({"grp": "doc_id", "node": "section_id", "parent": "parent_id"})


@_query
def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of an ancestor and a descendant."""
    return hierarchy.descendants(materialize(_tree(spark, d), "tree")).withColumnRenamed("grp", "doc_id")


@_query
def p6_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of every section by themselves and with all below: parent_section hangs units under the tree."""
    own = _ldus(spark, d, "doc_id", "parent_section").filter("parent_section IS NOT NULL").groupBy(F.col("doc_id").alias("grp"), F.col("parent_section").alias("node")).agg(F.count("*").alias("own"))
    have = materialize(_tree(spark, d).join(own, ["grp", "node"], "left").withColumn("own", F.coalesce("own", F.lit(0))), "tree")
    return have.join(hierarchy.subtree_sums(have, "own"), ["grp", "node"], "left").select(F.col("grp").alias("doc_id"), F.col("node").alias("section_id"), "own", F.col("total").alias("with_below"))


# Triage


@_query
def domain_score(spark: SparkSession, d: str) -> DataFrame:
    return triage.domains(table(spark, d, "documents"))


@_query
def language_guess(spark: SparkSession, d: str) -> DataFrame:
    return triage.languages(table(spark, d, "documents"))


@_query
def page_sample(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("doc_id", F.explode(triage.sample_pages(F.col("page_count"))).alias("page_ix"))


@_query
def page_stats(spark: SparkSession, d: str) -> DataFrame:
    s = triage.page_stats(_boxes(spark, d))
    return s.select("doc_id", "page_ix", *[F.round(c, 6).alias(c) for c in ("ink_density", "whitespace_ratio", "image_ratio")], F.col("char_density").cast("bigint").alias("chars"), "font_count", "vector_count")


def _origin(spark: SparkSession, d: str) -> DataFrame:
    s = triage.page_stats(_boxes(spark, d))
    return triage.origin_pages(s.withColumns({c: F.round(c, 9) for c in ("ink_density", "whitespace_ratio", "image_ratio")}))


@_query
def origin_pages(spark: SparkSession, d: str) -> DataFrame:
    return _origin(spark, d).select("doc_id", "page_ix", F.round("page_score", 5).alias("page_score"), "page_label")


@_query
def origin_documents(spark: SparkSession, d: str) -> DataFrame:
    o = triage.origins(_origin(spark, d))
    return o.select("doc_id", "origin_type", *[F.round(c, 4).alias(c) for c in ("origin_confidence", "avg_whitespace", "avg_ink", "avg_image")])


@_query
def profile_flags(spark: SparkSession, d: str) -> DataFrame:
    return triage.flags(table(spark, d, "profiles"))


@_query
def page_warnings(spark: SparkSession, d: str) -> DataFrame:
    w = triage.page_warnings(triage.page_stats(_boxes(spark, d)))
    return w.select("doc_id", F.array_join("warnings", ";").alias("warnings"))


def _layout(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).withColumnRenamed("page_number", "page_ix")
    fonts = b.groupBy("doc_id", "page_ix").agg(F.countDistinct(F.round(F.col("y1") - F.col("y0"), 2)).alias("unique_fonts"), F.count_if(F.col("text").contains("|")).alias("tables_detected"), F.round(F.avg((F.col("source_strategy") == "vision").cast("double")), 9).alias("image_ratio"), F.count("*").alias("graphic_groups"))
    var = triage.line_variance(b).withColumn("line_height_variance", F.round(F.col("line_height_variance") * 10000, 6))
    return triage.layout_signals(fonts.join(triage.column_estimates(b), ["doc_id", "page_ix"]).join(var, ["doc_id", "page_ix"]))


@_query
def layout_signals(spark: SparkSession, d: str) -> DataFrame:
    s = _layout(spark, d)
    return s.select("doc_id", "page_ix", "columns", *[F.round(f"{n}_score", 9 if n == "line_var" else 5).alias(f"{n}_score") for n in ("font", "group", "line_var", "column", "table")], F.round("layout_score", 4).alias("layout_score"))


@_query
def layout_documents(spark: SparkSession, d: str) -> DataFrame:
    return triage.layouts(_layout(spark, d)).select("doc_id", "layout_type", F.round("layout_confidence", 4).alias("layout_confidence"))


@_query
def graphic_groups(spark: SparkSession, d: str) -> DataFrame:
    return geometry.group_counts(_blocks(spark, d), 0.005)


@_query
def profile_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by current origin, layout and whether blocks were extracted."""
    b = table(spark, d, "text_blocks", "doc_id").distinct().withColumn("extracted", F.lit(True))
    return _profiles(spark, d).join(b, "doc_id", "left").groupBy("origin_type", "layout_type", F.coalesce("extracted", F.lit(False)).alias("extracted")).agg(F.count("*").alias("documents"), F.sum("page_count").alias("pages"))


# Geometry and chunking


@_query
def normalize_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes scaled to points, some reversed or over the edge, brought back to [0, 1]."""
    b = _blocks(spark, d)
    box = geometry.normalize_box(F.col("x1") * 650, F.col("y0") * 800, F.col("x0") * 650, F.col("y1") * 800, F.when(F.col("block_ix") % 17 == 0, 0.0).otherwise(612.0), F.lit(792.0), F.col("block_ix") % 2 == 0)
    return b.select("block_id", box.alias("b")).select("block_id", *[F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@_query
def invalid_scaled_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that lie over the edge or are turned round once they are scaled, and what is left of them within the page."""
    b = _blocks(spark, d).select("block_id", (F.col("x0") * 1.2 - 0.05).alias("x0"), (F.col("y0") * 1.2).alias("y0"), F.when(F.col("block_ix") % 7 == 0, F.col("x0")).otherwise(F.col("x1") * 1.2).alias("x1"), (F.col("y1") * 1.2).alias("y1"))
    return b.filter(~geometry.in_bounds()).select("block_id", *[F.round(T.clamp(F.col(c)), 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@_query
def invalid_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).filter(~geometry.in_bounds()).select("block_id")


@_query
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return geometry.reading_order(_blocks(spark, d).drop("column_id", "reading_order")).select("block_id", "column_id", "reading_order")


@_query
def block_types(spark: SparkSession, d: str) -> DataFrame:
    u = _ldus(spark, d, "content")
    return u.select("ldu_id", chunking.block_type(F.col("content")).alias("block_type"), T.token_count(F.col("content")).alias("tokens"), T.snippet(F.col("content")).alias("snippet"))


@_query
def junk_words(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("w"))
    return w.groupBy("doc_id").agg(F.count("*").alias("words"), F.count_if(T.is_junk(F.col("w"))).alias("junk"))


@_query
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Units cut at SPLIT_TOKENS: sentences packed, tables under their header, lists at items."""
    return chunking.chunks(_ldus(spark, d, "chunk_type", "content"), SPLIT_TOKENS)


def _built(spark: SparkSession, d: str) -> DataFrame:
    """Units of all blocks; vision blocks are figures, blocks with a bar are tables."""
    kind = F.when(F.col("source_strategy") == "vision", "figure").when(F.col("text").contains("|"), "table").otherwise("text")
    return chunking.build_units(_blocks(spark, d).withColumn("kind", kind).withColumn("reading_order", F.col("block_ix")), SPLIT_TOKENS)


@_query
def units_built(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from blocks to units: order, types, sections, cuts, context of lists, hashes."""
    return _built(spark, d).select("doc_id", "ldu_ix", "block_id", "chunk_type", "parent_section", "token_count", F.md5("content").alias("content_md5"), "content_hash")


@_query
def units_references(spark: SparkSession, d: str) -> DataFrame:
    """References between the units built of blocks."""
    u = materialize(_built(spark, d).withColumn("ldu_id", F.concat_ws(":", "doc_id", "ldu_ix")), "built")
    return chunking.resolve_references(u).select("ldu_id", "ref_type", "ref_value", "target", "dangling")


@_query
def section_assign(spark: SparkSession, d: str) -> DataFrame:
    return chunking.open_sections(_ldus(spark, d, "doc_id", "ldu_ix", "content")).select("ldu_id", "current_section")


@_query
def list_context(spark: SparkSession, d: str) -> DataFrame:
    return chunking.list_context(_ldus(spark, d, "doc_id", "ldu_ix", "content", "chunk_type"), 30).select("ldu_id", "carried")


@_query
def ldu_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hash of every unit with a box, and whether it is the first of its hash."""
    u = _ldus(spark, d, "content", "chunk_type", "bounding_box").filter("bounding_box.x0 IS NOT NULL")
    h = T.ldu_hash(F.col("content"), [F.col(f"bounding_box.{c}") for c in ("x0", "y0", "x1", "y1")], F.col("chunk_type"))
    return u.select("ldu_id", h.alias("hash")).withColumn("first", F.row_number().over(Window.partitionBy("hash").orderBy("ldu_id")) == 1)


@_query
def references(spark: SparkSession, d: str) -> DataFrame:
    r = chunking.resolve_references(_ldus(spark, d, "doc_id", "ldu_ix", "content", "chunk_type"))
    return r.select("ldu_id", "ref_type", "ref_value", "target", "dangling")


@_query
def table_relations(spark: SparkSession, d: str) -> DataFrame:
    return chunking.references(_ldus(spark, d, "doc_id", "ldu_ix", "content")).filter("related_table_id IS NOT NULL").select("ldu_id", "related_table_id")


@_query
def table_relations_built(spark: SparkSession, d: str) -> DataFrame:
    """Sentences about a table, made of the first words of units: the data have none of their own."""
    u = _ldus(spark, d, "doc_id", "ldu_ix", "content").withColumn("content", F.concat(F.when(F.col("ldu_ix") % 3 == 0, "As shown in Table ").otherwise("Table "), F.col("ldu_ix"), F.when(F.col("ldu_ix") % 2 == 0, " illustrates ").otherwise(" and "), F.left("content", F.lit(20))))
    return chunking.references(u).filter("related_table_id IS NOT NULL").select("ldu_id", "related_table_id")


@_query
def dangling_counts(spark: SparkSession, d: str) -> DataFrame:
    r = chunking.resolve_references(_ldus(spark, d, "doc_id", "ldu_ix", "content", "chunk_type"))
    return r.filter("dangling").groupBy("doc_id").agg(F.count("*").alias("dangling"))


@_query
def violations(spark: SparkSession, d: str) -> DataFrame:
    return chunking.violations(_ldus(spark, d))


# Sections


@_query
def section_index(spark: SparkSession, d: str) -> DataFrame:
    s = sections.build(_ldus(spark, d, "doc_id", "ldu_ix", "content", "chunk_type", "page_refs", "parent_section"))
    return s.select("doc_id", "section_id", "parent_id", "title", "page_start", "page_end", F.array_join("data_types_present", ",").alias("data_types"), "units", F.md5("content").alias("content_md5"), "summary")


@_query
def section_index_global(spark: SparkSession, d: str) -> DataFrame:
    """Units without a section go to section global; summaries are looked up."""
    kept = sections.current(table(spark, d, "sections")).filter("summary IS NOT NULL")
    s = sections.build(_ldus(spark, d, "doc_id", "ldu_ix", "content", "chunk_type", "page_refs", "parent_section"), kept, without="global")
    return s.select("doc_id", "section_id", "units", F.md5("summary").alias("summary_md5"))


@_query
def section_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the units with summaries of the default provider, their first two sentences."""
    s = sections.summarize(sections.build(_ldus(spark, d, "doc_id", "ldu_ix", "content", "chunk_type", "page_refs", "parent_section")))
    return s.select("doc_id", "section_id", F.md5("summary").alias("summary_md5"))


@_query
def section_navigate(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return sections.navigate(sections.current(table(spark, d, "sections")), "annual budget of the digital archive", 5).select("doc_id", "section_id", "score")


@_query
def section_search(spark: SparkSession, d: str) -> DataFrame:
    return sections.search(sections.current(table(spark, d, "sections")), "TABLES").select("doc_id", "section_id")


@_query
def section_json(spark: SparkSession, d: str) -> DataFrame:
    return sections.to_json(_tree(spark, d), sections.current(table(spark, d, "sections")))


@_query
def section_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts to embed, of root sections (no parent) only."""
    s = sections.embedding_text(sections.current(table(spark, d, "sections")).filter("parent_id IS NULL"))
    return s.select("doc_id", "section_id", F.md5("embedding_text").alias("text_md5"))


# Retrieval


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    items = v.select(F.col("vec_id").alias("item_id"), "embedding", F.col("label").alias("section"))
    return v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("section")), items


@_query
def knn_global(spark: SparkSession, d: str) -> DataFrame:
    r = retrieval.nearest(*_vectors(spark, d), k=5)
    return r.select("query_id", "item_id", F.round("distance", 5).alias("distance"), "rank")


@_query
def knn_sections(spark: SparkSession, d: str) -> DataFrame:
    r = retrieval.nearest(*_vectors(spark, d), k=3, restrict=True)
    return r.select("query_id", "item_id", F.round("distance", 5).alias("distance"), "rank")


@_query
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    r = retrieval.hybrid(*_vectors(spark, d))
    return r.select("query_id", "item_id", F.round("distance", 5).alias("distance"), "source")


@_query
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Share of the ten nearest within the section that are among the ten nearest of all."""
    q, items = _vectors(spark, d)
    return retrieval.recall(retrieval.nearest(q, items, 10), retrieval.nearest(q, items, 10, restrict=True).select("query_id", "item_id"))


# Facts


def _facts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts")
    names = [c for c in f.columns if c not in ("id", "ingested_at")]
    return f.groupBy("id").agg(F.max_by(F.struct(*names), "ingested_at").alias("r")).select("id", "r.*")


def _facts_sql(name: str, sql: str, typed: bool = True):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return facts.query(spark, _facts(spark, d), sql)

    run.__name__, run.__doc__ = name, sql
    _Q[name] = run


_facts_sql("facts_rollup", "SELECT fact_type, unit, count(*) AS n, count(DISTINCT entity) AS entities, CAST(sum(CAST(value_num AS DECIMAL(28,8))) AS DOUBLE) AS total FROM facts WHERE unit IS NOT NULL GROUP BY fact_type, unit HAVING count(*) > 3")
_facts_sql("facts_cube", "SELECT fact_type, unit, count(*) AS n FROM facts GROUP BY GROUPING SETS ((fact_type), (unit), ())")
_facts_sql("facts_window", "SELECT id, entity, row_number() OVER (PARTITION BY entity ORDER BY id) AS nth, lag(id) OVER (PARTITION BY entity ORDER BY id) AS before, count(*) OVER (PARTITION BY entity ORDER BY id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM facts")
_facts_sql("facts_setops", "SELECT entity FROM facts WHERE fact_type = 'metric' INTERSECT SELECT entity FROM facts WHERE fact_type = 'derived' EXCEPT SELECT entity FROM facts WHERE time_period IS NULL")
_facts_sql("facts_union", "SELECT entity, 'u' AS src FROM facts WHERE unit = 'kg' UNION SELECT entity, 'n' AS src FROM facts WHERE unit IS NULL")
_facts_sql("facts_selfjoin", "SELECT a.id AS id_a, b.id AS id_b FROM facts a JOIN facts b ON a.entity = b.entity AND a.time_period = b.time_period AND a.id < b.id WHERE a.unit = b.unit")
_facts_sql("facts_page", "SELECT id, entity FROM facts ORDER BY entity, id LIMIT 20 OFFSET 10")
_facts_sql("facts_like", "SELECT id FROM facts WHERE lower(entity) LIKE '%loan%' AND value_num BETWEEN 1 AND 500")


@_query
def facts_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Facts with a unit of text behind them, and those whose source is absent."""
    f, u = _facts(spark, d), table(spark, d, "ldus").select(F.col("content_hash").alias("source_hash")).distinct()
    there = f.join(u, "source_hash", "left_semi").select("id", F.lit("found").alias("source"))
    return there.unionByName(f.join(u, "source_hash", "left_anti").select("id", F.lit("dangling").alias("source")))


@_query
def facts_ingested(spark: SparkSession, d: str) -> DataFrame:
    """The facts and, with new ids after them, those of type metric once more."""
    f = _facts(spark, d)
    out = facts.ingest(f, f.filter("fact_type = 'metric'").drop("id"))
    return out.groupBy("fact_type").agg(F.count("*").alias("facts"), F.count_distinct("id").alias("ids"), F.max("id").alias("last"))


@_query
def facts_values(spark: SparkSession, d: str) -> DataFrame:
    return facts.typed(_facts(spark, d)).select("id", "value_num")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions made of entities: every fact whose id is divisible by 20."""
    return _facts(spark, d).filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.concat(F.lit("What is the "), F.col("fact_type"), F.lit(" "), F.element_at(F.split("entity", " "), 1), F.lit("?")).alias("query"))


@_query
def facts_lookup(spark: SparkSession, d: str) -> DataFrame:
    return facts.lookup(_facts(spark, d), _questions(spark, d))


# Extraction quality and ledger


def _page_confidence(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    p = b.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "block_id", "text"))), lambda x: x["text"]), " ").alias("text"), F.round(F.avg((F.col("source_strategy") == "vision").cast("double")), 6).alias("image_ratio"), F.countDistinct(F.round(F.col("y1") - F.col("y0"), 2)).alias("font_count"))
    p = p.withColumn("char_density", F.length("text") / 484704.0)
    return extraction.page_confidence(p)


@_query
def page_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _page_confidence(spark, d).select("doc_id", "page_number", F.round("confidence", 5).alias("confidence"))


@_query
def document_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The least confidence of the pages of every file, and whether all have some."""
    return extraction.document_confidence(_page_confidence(spark, d)).select("doc_id", F.round("confidence", 5).alias("confidence"), "all_healthy")


def _totals(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    kind = F.when(F.col("text").contains("|"), "table").when(T.is_header(F.col("text")), "header").otherwise("text")
    return extraction.totals(b.withColumn("kind", kind))


@_query
def extraction_totals(spark: SparkSession, d: str) -> DataFrame:
    t = extraction.confidences(_totals(spark, d))
    return t.select("doc_id", "pages", "pages_with_content", "blocks", "tables", "headers", "chars", *[F.round(c, 5).alias(c) for c in ("layout_confidence", "ocr_confidence", "vision_confidence")])


@_query
def extraction_health(spark: SparkSession, d: str) -> DataFrame:
    return extraction.health(_totals(spark, d), _profiles(spark, d).select("doc_id", "page_count"))


@_query
def ledger_attempts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("file_hash"), F.col("event_type").alias("strategy"), F.col("ts").alias("at"))
    return extraction.attempts(e).select("file_hash", "strategy", "attempts")


@_query
def ledger_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user up to a running sum."""
    e = table(spark, d, "events").select("event_id", "user_id", F.round("value", 2).cast("decimal(18,2)").alias("value"))
    return extraction.running_prefix(e, "user_id", "event_id", "value", 500).select("event_id", "user_id")


@_query
def ledger_missing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("fields"))
    return extraction.missing_fields(e, ["k", "status"]).select("event_id", F.array_join("missing", ",").alias("missing"))


@_query
def ledger_stream(spark: SparkSession, d: str) -> DataFrame:
    """Attempts by day and strategy from the events as a stream."""
    e = ledger.stream(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("strategy"), F.col("value").alias("confidence"))
    return ledger.run_once(ledger.attempts_by_window(e), f"ledger_stream_{uuid.uuid4().hex}")


# Answers


@_query
def query_classify(spark: SparkSession, d: str) -> DataFrame:
    q = _ldus(spark, d, "content")
    return q.select("ldu_id", agent.classify(F.col("content")).alias("engine"), agent.classify(F.col("content"), agent.QUANTITATIVE_CLI).alias("cli"))


@_query
def provenance_links(spark: SparkSession, d: str) -> DataFrame:
    return agent.provenance(_ldus(spark, d, "content", "page_refs", "content_hash", "metadata"))


@_query
def answers_cited(spark: SparkSession, d: str) -> DataFrame:
    """For each looked-up question an answer that cites the fact's document, or the refusal."""
    f = _facts(spark, d)
    q = facts.lookup(f, _questions(spark, d)).join(f.select(F.col("id").alias("query_id"), "document_name"), "query_id")
    links = F.when(F.col("value").isNotNull(), F.array(F.struct("document_name", F.lit(0).alias("page_number"))))
    s = q.withColumn("retrieved_context", F.concat(F.lit("SQL Result: "), F.col("value"))).withColumn("provenance_links", links)
    return agent.synthesize(s).select("query_id", "final_answer")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """Every unit with its whole first sentence. A sentence ends before a letter that is no small one, so that p.m. and e.g. end none."""
    u = _ldus(spark, d, "doc_id", "ldu_ix", "content", "content_hash")
    return u.withColumn("claim", F.split(F.ltrim("content"), r"(?<=[.!?])\s+(?=[\"“«(]*[\p{Lu}\p{Lo}])", 2)[0]).withColumnRenamed("ldu_id", "claim_id")


@_query
def audit_claims(spark: SparkSession, d: str) -> DataFrame:
    """The first sentence of every unit, in capitals, against the units before and after it in the file."""
    u = _claims(spark, d)
    near = u.select("claim_id", "doc_id", F.explode(F.array(F.col("ldu_ix") - 1, F.col("ldu_ix") + 1)).alias("ldu_ix"))
    src = near.join(u.select("doc_id", "ldu_ix", "content_hash", "content"), ["doc_id", "ldu_ix"]).select("claim_id", "content_hash", "content")
    return agent.audit(u.select("claim_id", F.upper("claim").alias("claim")), src).select("claim_id", "status", F.size("provenance_hashes").alias("hashes"))


@_query
def audit_units(spark: SparkSession, d: str) -> DataFrame:
    """The whole first sentence of every unit as a claim, against all other units of its file (its own text would verify any claim)."""
    units = _claims(spark, d).select("claim_id", "doc_id", "claim", "content", "content_hash")
    return agent.audit_within(units, "doc_id").select("claim_id", "status", F.size("provenance_hashes").alias("hashes"))


@_query
def facts_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with a unit in the text of units."""
    return facts.extract(_ldus(spark, d, "content"))


@_query
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest units, by hashed embeddings, of every unit whose id is divisible by 20."""
    u = _ldus(spark, d, "content").select(F.col("ldu_id").alias("item_id"), embedding.hashed(F.col("content")).alias("embedding"))
    return retrieval.nearest(u.filter("item_id % 20 = 0").withColumnRenamed("item_id", "query_id"), u, k=2).select("query_id", "item_id", F.round("distance", 5).alias("distance"), "rank")


# Reports


@_query
def density_report(spark: SparkSession, d: str) -> DataFrame:
    r = reports.density(_blocks(spark, d))
    return r.select("doc_id", "total_chars", "pages", *[F.round(c, 4).alias(c) for c in ("bbox_height_mean", "bbox_height_std", "bbox_width_mean", "bbox_width_std", "avg_whitespace", "avg_vectors")], F.round("page_char_variance", 2).alias("page_char_variance"), "hint")


@_query
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.markdown(table(spark, d, "documents"))


@_query
def compare_report(spark: SparkSession, d: str) -> DataFrame:
    """Characters of blocks against characters of units, by file."""
    a = reports.density(_blocks(spark, d)).select("doc_id", F.col("total_chars").alias("chars"), "hint")
    return reports.compare(a, _ldus(spark, d, "doc_id", "content").groupBy("doc_id").agg(F.sum(F.length("content")).alias("chars")))


@_query
def table_headers(spark: SparkSession, d: str) -> DataFrame:
    return reports.table_header_ratio(_ldus(spark, d, "chunk_type", "content").filter("chunk_type = 'table'"))


@_query
def page_overlay(spark: SparkSession, d: str) -> DataFrame:
    pages = _blocks(spark, d).select("doc_id", "page_number").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    return sources.page_overlay(_ldus(spark, d, "doc_id", "page_refs", "bounding_box", "chunk_type"), pages)


@_query
def page_units(spark: SparkSession, d: str) -> DataFrame:
    """Units by first page, and the thirds and picks of every file by position."""
    u = _ldus(spark, d, "doc_id", "ldu_ix", "page_refs")
    w = Window.partitionBy("doc_id")
    u = u.withColumn("n", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy("ldu_ix", "ldu_id")))
    third = F.when(F.col("n") < 3, 2).otherwise(F.least(F.floor((F.col("rn") - 1) / F.floor(F.col("n") / 3)), F.lit(2))).cast("int")
    pick = (F.col("rn") - 1).isin(F.floor(F.col("n") / 10)) | ((F.col("rn") - 1) == F.floor(F.col("n") / 2)) | ((F.col("rn") - 1) == F.col("n") - 1 - F.floor(F.col("n") / 10))
    return u.select("ldu_id", F.try_element_at("page_refs", F.lit(1)).alias("first_page"), third.alias("third"), pick.alias("picked"))


@_query
def vector_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What of the metadata goes with a vector: fields that are not null."""
    u = _ldus(spark, d, "chunk_type", "parent_section", "content_hash")
    m = T.sanitized(F.create_map(F.lit("chunk_type"), "chunk_type", F.lit("parent_section"), "parent_section", F.lit("content_hash"), "content_hash"))
    return u.select("ldu_id", F.array_join(F.transform(F.sort_array(F.map_keys(m)), lambda k: F.concat(k, F.lit("="), m[k])), ";").alias("metadata"))


@_query
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Units by content hash: a second delivery of some replaces the first."""
    u = _ldus(spark, d, "content_hash", "chunk_type").filter("content_hash IS NOT NULL").groupBy(F.col("content_hash").alias("id")).agg(F.min("ldu_id").alias("ldu_id"))
    return sources.upsert(u, u.filter("ldu_id % 3 = 0").withColumn("ldu_id", -F.col("ldu_id")))


QUERIES = _Q
__all__ = ["ORACLE", "QUERIES"]
