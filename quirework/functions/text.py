"""Column functions over text, hashes and boxes. All of them stay on the JVM; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def is_title(text: Column) -> Column:
    """Every run of cased letters begins with a capital and goes on in small letters, and there is one at least."""
    return text.rlike(r"[\p{Lu}\p{Lt}]") & ~text.rlike(rf"[{_CASED}][\p{{Lu}}\p{{Lt}}]") & ~text.rlike(rf"(^|[^{_CASED}])\p{{Ll}}")


def is_header(text: Column) -> Column:
    return (F.length(text) < 100) & is_title(text) & ~text.endswith(".")


def is_list(text: Column) -> Column:
    return text.rlike(r"^(\d+\.|-|\*)\s+")


def snippet(text: Column, words: int = 30) -> Column:
    """The first words, with dots if there are more."""
    t = tokens(text)
    return F.concat(F.array_join(F.slice(t, 1, words), " "), F.when(F.size(t) > words, "...").otherwise(""))


def is_junk(word: Column) -> Column:
    """Empty, longer than 40, without letters and digits, mostly symbols around digits, or a letter four times in a row."""
    letters, digits = word.rlike(r"\p{L}"), word.rlike(r"\d")
    share = F.length(F.regexp_replace(word, r"[^\p{L}\p{N}]", "")) / F.length(word)
    return (F.length(word) == 0) | (F.length(word) > 40) | (~letters & ~digits) | (digits & ~letters & (share < 0.5)) | word.rlike(r"(\p{L})\1{3}")


def float_text(x: Column) -> Column:
    """x to four places the way a number is written in a signature: 0.1, 0.0005, 1.0."""
    return F.regexp_replace(F.round(x, 4).cast("decimal(9,4)").cast("string"), r"(\.\d+?)0+$", "$1")


def ldu_hash(content: Column, box: list[Column], chunk_type: Column) -> Column:
    """SHA-256 of content, box to four places and type; pages do not count."""
    numbers = F.concat(F.lit("bbox:["), F.concat_ws(", ", *[float_text(x) for x in box]), F.lit("]"))
    return F.sha2(F.concat_ws("|", strip(content), numbers, F.concat(F.lit("type:"), chunk_type)), 256)


def json_in(text: Column) -> Column:
    """The JSON object, else the JSON array, inside fences or prose; the trimmed text if there is none."""
    t = strip(text)
    obj, arr = F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.regexp_extract(t, r"(?s)(\[.*\])", 1)
    return F.when(obj != "", obj).when(arr != "", arr).otherwise(t)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def sanitized(metadata: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(metadata, lambda _, v: v.isNotNull())


def like_term(column: Column, term: Column) -> Column:
    """Case-insensitive LIKE '%term%'; _ and % in the term are wildcards."""
    return F.lower(column).like(F.concat(F.lit("%"), F.lower(term), F.lit("%"))) if not isinstance(term, Column) else F.ilike(column, F.concat(F.lit("%"), term, F.lit("%")))


def numeric_prefix(text: Column) -> Column:
    """The number a text begins with, as SQLite reads it; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1), F.lit("")).try_cast("double")


def sql_embedding_text(title: Column, summary: Column) -> Column:
    return F.format_string("Section: %s\nSummary: %s", title, summary)
