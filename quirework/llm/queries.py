"""Queries of the training-data operators (problems 1, 3, 4, 5, 7, 8, 9, 10) and their SQL, where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import language, leakage, near_duplicates, packing, repeated_lines, scan_noise, sentences, splitting
from quirework.session import config_value, table


def _limits(spark: SparkSession, d: str) -> tuple[int, int]:
    return config_value(spark, d, "MAX_LDU_TOKENS", 800), config_value(spark, d, "CHUNK_OVERLAP", 50)


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized LDU."""
    return splitting.split_oversized(table(spark, d, "ldus"), *_limits(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """LDUs that had to be cut as they have too many tokens (p1_pieces also cuts long texts without spaces)."""
    return p1_pieces(spark, d).filter("piece_ix = 1").filter(F.col("unit_tokens") > _limits(spark, d)[0]).select("ldu_id").distinct()


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The text of every cut LDU put together from its pieces, and whether all pieces are within the limit and overlap as they should."""
    limit, overlap = _limits(spark, d)
    p = p1_pieces(spark, d).filter(F.col("unit_tokens") > limit)
    right = (F.col("token_count") <= limit) & (F.col("overlap_tokens") == F.when(F.col("piece_ix") > 0, overlap).otherwise(0))
    return splitting.rebuilt(p).select("ldu_id", F.md5("text").alias("text_md5")).join(p.groupBy("ldu_id").agg(F.bool_and(right).alias("right")), "ldu_id")


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.near_duplicates(table(spark, d, "ldus").filter("chunk_type = 'text'"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of text LDUs of similarity 0.5 or more over three-word shingles."""
    return near_duplicates.all_pairs(*_near(spark, d)).select(F.col("id_a").alias("ldu_id_a"), F.col("id_b").alias("ldu_id_b")).distinct()


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a text LDU: class, number of links, group of all that are linked."""
    return near_duplicates.groups(*_near(spark, d)).withColumnRenamed("id", "ldu_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Where the lines repeated within a source stand."""
    return repeated_lines.repeated_lines(table(spark, d, "text_blocks"))


def p4_lines(spark: SparkSession, d: str) -> DataFrame:
    """The repeated lines of every source, with counts."""
    return repeated_lines.frequent_lines(table(spark, d, "text_blocks")).select("source", F.col("example").alias("line"), "files", "source_files")


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every block without the repeated lines."""
    return repeated_lines.without_repeated(table(spark, d, "text_blocks"))


def _boundaries(spark: SparkSession, d: str) -> sentences.Model:
    return sentences.train_on(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def _languages(spark: SparkSession, d: str) -> tuple[sentences.Model, language.Model]:
    cuts = _boundaries(spark, d)
    return cuts, language.train_on(table(spark, d, "lang_samples"), table(spark, d, "documents"), cuts)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of whole sentences that the current profile of the document does not name."""
    return language.unnamed_languages(table(spark, d, "documents"), table(spark, d, "profiles"), *_languages(spark, d))


def p5_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Single-language stretches of every document, with confidence."""
    return language.stretches(table(spark, d, "documents"), *_languages(spark, d))


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    """Main language of every document, with confidence and all its languages."""
    return language.document_languages(p5_stretches(spark, d), table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of defects of every block and LDU."""
    return scan_noise.defects(table(spark, d, "text_blocks"), table(spark, d, "ldus"))


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Readable paragraphs of every file."""
    return scan_noise.repaired(table(spark, d, "text_blocks"), table(spark, d, "ldus"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of PACK_CAPACITY_TOKENS."""
    return packing.pack_documents(table(spark, d, "documents"), config_value(spark, d, "PACK_CAPACITY_TOKENS", 2048))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold twelve or more consecutive words of an evaluation item."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Where every sentence of every document starts."""
    return sentences.sentence_starts(table(spark, d, "documents"), _boundaries(spark, d))


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every document in order."""
    return sentences.sentences(table(spark, d, "documents"), _boundaries(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_rebuilt, p3_found, p3_groups, p4_found, p4_lines, p4_cleaned, p5_found, p5_stretches, p5_documents, p7_found, p7_repaired, p8_packed, p9_found, p10_found, p10_sentences)}

_LINES = r"""
WITH lines AS (
  SELECT block_id, doc_id, source, i - 1 AS line_no, trim(regexp_replace(lower(string_split(text, chr(10))[i]), '[^\p{L}\p{M}]+', ' ', 'g')) AS n
  FROM text_blocks, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i) WHERE doc_id IS NOT NULL),
usable AS (SELECT * FROM lines WHERE len(string_split(n, ' ')) >= 4),
sizes AS (SELECT source, count(DISTINCT doc_id) AS source_files FROM text_blocks GROUP BY source),
frequent AS (SELECT u.source, n, count(DISTINCT doc_id) AS files, any_value(source_files) AS source_files FROM usable u JOIN sizes s ON u.source = s.source
  GROUP BY u.source, n HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.2 * any_value(source_files))
"""

# Distinct three-word sequences of every text of thirty words; a word is a run of letters or digits in lower case.
_SHINGLES = r"""
WITH t AS (SELECT ldu_id, any_value(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS w FROM ldus WHERE chunk_type = 'text' AND content IS NOT NULL GROUP BY ldu_id),
s AS (SELECT DISTINCT ldu_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t WHERE len(w) >= 30),
n AS (SELECT ldu_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.ldu_id AS a, b.ldu_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.ldu_id < b.ldu_id GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n x ON x.ldu_id = a JOIN n y ON y.ldu_id = b WHERE c >= 0.5 * (x.n + y.n - c))
"""

ORACLE = {
    "p3_found": _SHINGLES + "SELECT a AS ldu_id_a, b AS ldu_id_b FROM p",
    "p3_groups": _SHINGLES.replace("WITH t AS", "WITH RECURSIVE t AS") + """, k AS (SELECT ldu_id, md5(string_agg(g, '|' ORDER BY g)) AS k FROM s GROUP BY 1), c1 AS (SELECT ldu_id, min(ldu_id) OVER (PARTITION BY k) AS class_id FROM k), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), walk AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM walk w JOIN e ON e.a = w.b)
SELECT ldu_id, class_id, (SELECT count(*) FROM e WHERE e.a = ldu_id) AS links, least(ldu_id, coalesce((SELECT min(b) FROM walk WHERE walk.a = ldu_id), ldu_id)) AS group_id FROM c1""",
    "p9_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL), i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL),
r AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12), q AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM r JOIN q USING (g)""",
    "p4_cleaned": _LINES + """, gone AS (SELECT DISTINCT block_id, line_no FROM usable u JOIN frequent f ON u.source = f.source AND u.n = f.n), g AS (SELECT block_id, list(line_no) AS l FROM gone GROUP BY 1),
o AS (SELECT DISTINCT ON (block_id) doc_id, page_number, block_ix, block_id, text, string_split(text, chr(10)) AS all_ FROM text_blocks), k AS (SELECT o.*, l, list_filter(all_, lambda x, i: l IS NULL OR NOT list_contains(l, i - 1)) AS left_ FROM o LEFT JOIN g USING (block_id))
SELECT doc_id, page_number, block_ix, block_id, CASE WHEN text IS NOT NULL THEN array_to_string(left_, chr(10)) END AS text, CAST(coalesce(len(l), 0) AS INTEGER) AS lines_removed FROM k WHERE text IS NULL OR len(left_) > 0""",
    "p1_found": r"SELECT DISTINCT ldu_id FROM ldus WHERE len(regexp_extract_all(content, '\S+')) > (SELECT max(setting_value) FROM pipeline_config WHERE setting = 'MAX_LDU_TOKENS')",
    "p1_rebuilt": r"SELECT ldu_id, md5(max(content)) AS text_md5, true AS right FROM ldus WHERE len(regexp_extract_all(content, '\S+')) > (SELECT max(setting_value) FROM pipeline_config WHERE setting = 'MAX_LDU_TOKENS') GROUP BY ldu_id",
    "p4_found": _LINES + "SELECT DISTINCT block_id, CAST(line_no AS INTEGER) AS line_no FROM usable u JOIN frequent f ON u.source = f.source AND u.n = f.n",
    "p4_lines": _LINES + "SELECT source, n AS line, files, source_files FROM frequent",
}
