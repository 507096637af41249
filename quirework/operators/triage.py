"""Document profiles from page signals: origin, layout, domain, language."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import text as T
from quirework.session import spread

# Word stems of each domain, in the order that breaks ties.
LEXICON = {
    "financial": ["revenue", "audit", "balance sheet", "dividend", "profit", "loss statement", "asset", "liabilit", "financ", "capital", "equity", "interest rate", "income statement", "shareholder", "deposit", "loan", "bank", "insurance", "portfolio"],
    "legal": ["pursuant", "statute", "regulat", "complian", "jurisdict", "legislat", "ordinance", "contractual", "litigat", "arbitrat", "enforc", "penal", "constitut"],
    "technical": ["methodolog", "hypothes", "experiment", "empiric", "variable", "dataset", "peer review", "abstract", "observat", "algorithm", "architecture", "engineering", "infrastructure"],
    "medical": ["patient", "clinical", "diagnos", "prescription", "symptom", "therap", "physician", "hospital", "treatment", "disease", "health", "syndrome", "vaccin"],
    "governmental": ["ministry", "government", "administration", "agency", "bureau", "federal", "public sector", "policy", "governance", "accountability"],
}
# Function words of the default language provider.
STOPWORDS = {
    "en": ["the", "of", "and", "its", "by", "in"], "fr": ["le", "la", "les", "un", "avec", "de"], "es": ["el", "los", "las", "con", "por", "del"],
    "pt": ["o", "os", "as", "com", "um", "da"], "de": ["der", "die", "das", "den", "mit", "ohne"], "ru": ["не", "до", "в", "с", "под", "на"],
}


@dataclass(frozen=True)
class TriageConfig:
    """Thresholds and weights; weights must sum to 1."""

    ink_full: float = 0.02
    whitespace_full: float = 0.95
    vectors_full: int = 5
    digital_from: float = 0.6
    scanned_to: float = 0.4
    origin_weights: dict[str, float] = field(default_factory=lambda: {"ink": 0.35, "whitespace": 0.25, "image": 0.2, "font": 0.1, "vector": 0.1})
    layout_ceilings: dict[str, float] = field(default_factory=lambda: {"font": 10.0, "group": 20.0, "line_var": 200.0, "column": 3.0, "table": 5.0})
    layout_weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(("font", "group", "line_var", "column", "table"), 0.2))
    min_domain_tokens: int = 50
    min_language_tokens: int = 20

    def __post_init__(self):
        for name in ("origin_weights", "layout_weights"):
            if abs(sum(getattr(self, name).values()) - 1) > 1e-6:
                raise ValueError(f"{name} must sum to 1")


def sample_pages(n: Column) -> Column:
    """All of up to five pages, else the first two, the middle one and the last two; none for null or 0."""
    few = F.when(n > 0, F.sequence(F.lit(0), F.least(n, F.lit(5)) - 1)).otherwise(F.array().cast("array<int>"))
    many = F.array_sort(F.array_distinct(F.array(F.lit(0), F.lit(1), F.floor(n / 2).cast("int"), n - 2, n - 1)))
    return F.when(n > 5, many).otherwise(F.coalesce(few, F.array().cast("array<int>")))


def page_stats(boxes: DataFrame, page_area: float = 1.0) -> DataFrame:
    """Signals per (doc_id, page_ix) of boxes (doc_id, page_ix, kind char|image|vector, x0, y0, x1, y1, n_chars, font).

    One shuffle on the page, partial sums first. A page without area counts as blank (whitespace 1).
    """
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, area)), F.lit(0.0)) / page_area
    s = boxes.groupBy("doc_id", "page_ix").agg(of("char").alias("ink"), of("image").alias("img"), (F.coalesce(F.sum("n_chars"), F.lit(0)) / page_area).alias("char_density"), F.countDistinct("font").alias("font_count"), F.count_if(F.col("kind") == "vector").alias("vector_count"))
    return s.select("doc_id", "page_ix", F.col("ink").alias("ink_density"), "char_density", F.greatest(F.lit(0.0), 1 - F.col("ink") - F.col("img")).alias("whitespace_ratio"), F.col("img").alias("image_ratio"), "font_count", "vector_count")


def origin_score(cfg: TriageConfig = TriageConfig()) -> Column:
    w = cfg.origin_weights
    get = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        w["ink"] * F.least(get("ink_density") / cfg.ink_full, F.lit(1.0))
        + w["whitespace"] * (1 - F.least(F.coalesce("whitespace_ratio", F.lit(1.0)) / cfg.whitespace_full, F.lit(1.0)))
        + w["image"] * (1 - F.least(get("image_ratio"), F.lit(1.0)))
        + w["font"] * F.least(get("font_count"), F.lit(1))
        + w["vector"] * F.least(get("vector_count") / cfg.vectors_full, F.lit(1.0))
    )


def origin_pages(stats: DataFrame, cfg: TriageConfig = TriageConfig()) -> DataFrame:
    """stats with page_score and page_label (digital, scanned, ambiguous)."""
    s = stats.withColumn("page_score", F.round(origin_score(cfg), 6))
    return s.withColumn("page_label", F.when(F.col("page_score") >= cfg.digital_from, "digital").when(F.col("page_score") <= cfg.scanned_to, "scanned").otherwise("ambiguous"))


def origins(pages: DataFrame) -> DataFrame:
    """(doc_id, origin_type, origin_confidence, avg_whitespace, avg_ink, avg_image); scores are rounded before the mean."""
    g = pages.groupBy("doc_id").agg(F.count_if(F.col("page_label") == "digital").alias("d"), F.count_if(F.col("page_label") == "scanned").alias("s"), F.avg("page_score").alias("m"), F.avg("whitespace_ratio").alias("w"), F.avg("ink_density").alias("i"), F.avg("image_ratio").alias("g"))
    kind = F.when((F.col("d") > 0) & (F.col("s") > 0), "mixed").when(F.col("s") > 0, "scanned").otherwise("digital_native")
    conf = F.when(kind == "scanned", 1 - F.col("m")).when(kind == "mixed", 1 - 2 * F.abs(F.col("m") - 0.5)).otherwise(F.col("m"))
    return g.select("doc_id", kind.alias("origin_type"), F.round(conf, 6).alias("origin_confidence"), F.round("w", 6).alias("avg_whitespace"), F.round("i", 6).alias("avg_ink"), F.round("g", 6).alias("avg_image"))


def column_estimates(words: DataFrame, gap: float = 0.1, most: int = 3) -> DataFrame:
    """(doc_id, page_ix, columns): 1 and one more for each gap between neighbouring left edges, at most `most`."""
    step = F.col("x0") - F.lag("x0").over(Window.partitionBy("doc_id", "page_ix").orderBy("x0"))
    return words.withColumn("_g", step).groupBy("doc_id", "page_ix").agg(F.least(1 + F.count_if(F.col("_g") > gap), F.lit(most)).cast("int").alias("columns"))


def line_variance(words: DataFrame) -> DataFrame:
    """(doc_id, page_ix, line_height_variance): sample variance of the positive steps between tops; 0 for fewer than two."""
    step = F.col("y0") - F.lag("y0").over(Window.partitionBy("doc_id", "page_ix").orderBy("y0"))
    return words.withColumn("_d", step).groupBy("doc_id", "page_ix").agg(F.coalesce(F.var_samp(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0.0)).alias("line_height_variance"))


def layout_signals(pages: DataFrame, cfg: TriageConfig = TriageConfig()) -> DataFrame:
    """Five capped signals and their weighted score, from unique_fonts, graphic_groups, line_height_variance, columns, tables_detected."""
    c, w = cfg.layout_ceilings, cfg.layout_weights
    source = {"font": "unique_fonts", "group": "graphic_groups", "line_var": "line_height_variance", "column": "columns", "table": "tables_detected"}
    out = pages.withColumns({f"{k}_score": F.least(F.col(v) / c[k], F.lit(1.0)) for k, v in source.items()})
    return out.withColumn("layout_score", sum((F.col(f"{k}_score") * w[k] for k in source), F.lit(0.0)))


def layouts(signals: DataFrame, image_ratio: str = "image_ratio") -> DataFrame:
    """(doc_id, layout_type, layout_confidence): best category by mean signals, its margin, mixed where three signals are up and the margin is small; the margin is held within [0, 1]."""
    names = ["font", "group", "line_var", "column", "table"]
    a = signals.groupBy("doc_id").agg(*[F.avg(f"{n}_score").alias(n) for n in names], F.avg(image_ratio).alias("figure"))
    tg = F.round(F.col("table") + F.col("group"), 9)
    a = a.withColumns({"tg": tg, "figure": F.round("figure", 9), "column": F.round("column", 9)}).withColumn("single", F.greatest(F.lit(0.0), 1 - F.greatest("tg", "figure", "column")))
    rank = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (c, n) in enumerate((("tg", "table_heavy"), ("figure", "figure_heavy"), ("column", "multi_column"), ("single", "single_column")))]))
    a = a.withColumn("rank", rank).withColumn("top", F.col("rank")[0])
    other = F.filter("rank", lambda x: x["n"] != "single_column")
    second = F.when(F.col("top.n") == "single_column", F.col("rank")[1]["s"]).otherwise(other[1]["s"])
    conf = -F.col("top.s") + second
    active = sum((F.when(F.round(n, 9) > 0.3, 1).otherwise(0) for n in names), F.lit(0))
    kind = F.when((active >= 3) & (conf < 0.15), "mixed").otherwise(F.col("top.n"))
    return a.select("doc_id", kind.alias("layout_type"), F.round(T.clamp(conf), 6).alias("layout_confidence"))


def _separate(stems: list[str]) -> bool:
    """Whether no match of one stem can hide a match of another: none begins with another, nor does a later word of it."""
    parts = [(i, " ".join(s.split(" ")[k:])) for i, s in enumerate(stems) for k in range(s.count(" ") + 1)]
    return not any(i != j and (p.startswith(t) or t.startswith(p)) for i, p in parts for j, t in enumerate(stems))


def domain_hits(text: Column, lexicon: dict[str, list[str]] = LEXICON) -> Column:
    """ARRAY<INT>, the hits of each domain: words that begin with a stem, summed by stem; governmental counts double.

    One regular expression finds the matches of all stems, which are then few to tell apart; stems that can overlap are searched one by one.
    """
    low = F.lower(text)
    stems = [s for x in lexicon.values() for s in x]
    twice = lambda d: 2 if d == "governmental" else 1
    if not _separate(stems):
        return F.array(*[(sum((F.regexp_count(low, F.lit(rf"(?U)\b{s}\w*\b")) for s in x), F.lit(0)) * twice(d)).cast("int") for d, x in lexicon.items()])
    by_letter: dict[str, list[str]] = {}
    for s in stems:
        by_letter.setdefault(s[0], []).append(s[1:])
    pattern = r"(?<![\p{L}\p{N}_])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items())) + ")"
    of = F.create_map(*[F.lit(v) for i, x in enumerate(lexicon.values()) for s in x for v in (s, i)])
    found = F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), lambda m: of[m])
    weights = [twice(d) for d in lexicon]
    return F.transform(F.array(found), lambda ms: F.array(*[(F.size(F.filter(ms, _is(i))) * w).cast("int") for i, w in enumerate(weights)]))[0]


def _is(i: int):
    return lambda x: x == i


def domains(documents: DataFrame, cfg: TriageConfig = TriageConfig(), lexicon: dict[str, list[str]] = LEXICON, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, domain_hint, domain_confidence): the domain of most hits and its margin over the next, as shares of all hits; (general, 0) for few tokens or no hit. No shuffle."""
    h = spread(documents.select(F.col(key), F.col(text).alias("_t"))).select(F.col(key), T.token_count(F.col("_t")).alias("n"), domain_hits(F.col("_t"), lexicon).alias("h"))
    total = F.aggregate("h", F.lit(0), lambda a, x: a + x)
    ranked = F.array_sort(F.transform("h", lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    h = h.withColumns({"total": total, "r": ranked})
    known = (F.col("n") >= cfg.min_domain_tokens) & (F.col("total") > 0)
    names = F.array(*[F.lit(d) for d in lexicon])
    margin = (F.col("r")[1]["s"] - F.col("r")[0]["s"]) / F.col("total")
    return h.select(key, F.when(known, names[F.col("r")[0]["i"]]).otherwise("general").alias("domain_hint"), F.when(known, F.round(margin, 6)).otherwise(0.0).alias("domain_confidence"))


def _among(array: str, words: list[str]) -> Column:
    return F.size(F.filter(array, lambda x: x.isin(words)))


def languages(documents: DataFrame, cfg: TriageConfig = TriageConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, language_confidence) of the default provider: share of function words; (unknown, 0) for few tokens or none."""
    t = documents.select(key, T.tokens(F.lower(F.col(text))).alias("t"))
    counts = F.array(*[_among("t", ws) for ws in STOPWORDS.values()])
    t = t.withColumn("c", counts).withColumn("total", F.aggregate("c", F.lit(0), lambda a, x: a + x)).withColumn("r", F.array_sort(F.transform("c", lambda x, i: F.struct((-x).alias("s"), i.alias("i")))))
    known = (F.size("t") >= cfg.min_language_tokens) & (F.col("total") > 0)
    names = F.array(*[F.lit(x) for x in STOPWORDS])
    return t.select(key, F.when(known, names[F.col("r")[0]["i"]]).otherwise("unknown").alias("language"), F.when(known, F.round(-F.col("r")[0]["s"] / F.col("total"), 6)).otherwise(0.0).alias("language_confidence"))


def flags(runs: DataFrame) -> DataFrame:
    """(doc_id, encrypted, form) of runs (doc_id, is_encrypted, origin_type): a file that could not be opened in any of its runs (null) counts as encrypted; form where a run found fillable fields."""
    return runs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(F.coalesce("is_encrypted", F.lit(True))).alias("encrypted"), F.bool_or(F.coalesce(F.col("origin_type").contains("form"), F.lit(False))).alias("form"))


def page_warnings(stats: DataFrame) -> DataFrame:
    """(doc_id, warnings): empty pages and pages with text but no ink, in page order."""
    w = F.filter(F.array(F.when(F.col("char_density") == 0, F.concat(F.lit("page "), F.col("page_ix"), F.lit(": empty"))), F.when((F.col("char_density") > 0) & (F.col("ink_density") < 0.001), F.concat(F.lit("page "), F.col("page_ix"), F.lit(": text without ink")))), lambda x: x.isNotNull())
    return stats.withColumn("_w", w).groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("_w"))).alias("warnings"))
