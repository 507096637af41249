"""Oversized texts cut into overlapping pieces at natural boundaries.

The text is cut by a hierarchy of separators: section, paragraph, line, sentence, word, character. A part that is
too large is cut by the next separator; the parts are then packed greedily up to the limit, and every piece but the
first begins with the last tokens of the one before. Pieces are slices of the text, so that leaving out each overlap
gives the text back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places after which a text may be cut, widest first; words and characters follow.
SEPARATORS = [
    ("section", re.compile(r"\n(?=[^\S\n]*(?:#{1,6}[^\S\n]|(?:Section|Chapter|Article|Part)\s+[\dIVXLC]+|\d+(?:\.\d+)+\.?[^\S\n]+\S))|\f")),
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*")),
    ("line", re.compile(r"\n(?=[^\S\n]*(?:[*•-]|\d+[.)])[^\S\n])")),
    ("sentence", re.compile(r"[.!?…؟።।]+[\"”»’')\]]*\s+|[。！？]+[」』”]*\s*")),
]
TOKEN = re.compile(r"\S+")
#: A run without space counts as a token for every so many characters begun: more than any word has, so that only text without spaces and noise are cut by characters.
MOST_CHARS = 200

COLUMNS = "piece_ix int, start bigint, own_start bigint, end bigint, boundary string, token_count int, overlap_tokens int, piece string"


def _atoms(text: str, a: int, b: int, limit: int, tokens: list[tuple[int, int, bool]], lo: int, hi: int, level: int) -> Iterator[tuple[int, int, str]]:
    """(first token, token after the last, separator behind it) of parts of tokens[lo:hi] of at most limit tokens."""
    if hi - lo <= limit:
        yield lo, hi, SEPARATORS[level - 1][0] if level else "end"
        return
    if level == len(SEPARATORS):
        at = lo
        words = [k for k in range(lo, hi) if tokens[k][2]]
        for k, after in zip(words, [*words[1:], hi], strict=True):
            if after - at > limit and k > at:
                yield at, k, "word"
                at = k
            while after - at > limit:  # a word that alone is too large
                yield at, at + limit, "character"
                at += limit
        yield at, hi, SEPARATORS[-1][0]
        return
    at, cuts = lo, [m.end() for m in SEPARATORS[level][1].finditer(text, a, b)]
    k = lo
    for cut in [*cuts, b]:
        while k < hi and tokens[k][0] < cut:
            k += 1
        if k > at:
            yield from _atoms(text, tokens[at][0], cut, limit, tokens, at, k, level + 1)
            at = k


def split(text: str | None, limit: int, overlap: int, most_chars: int = MOST_CHARS) -> list[tuple[int, int, int, int, str, int, int, str]]:
    """Pieces of a text: COLUMNS. A text within the limit is one piece; null or blank text has none.

    boundary is the widest separator behind the piece, end for the last. Sizes are runs of non-space, a run of more than most_chars characters
    counting once for every most_chars begun; such a run is cut by characters only if it alone exceeds the limit.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than the limit")
    tokens = [(k, min(b, k + most_chars), k == a) for a, b in (m.span() for m in TOKEN.finditer(text or "")) for k in range(a, b, most_chars)]
    n = len(tokens)
    if not n:
        return []
    if n <= limit:
        return [(0, 0, 0, len(text), "end", n, 0, text)]
    groups: list[list] = []  # [first, after, separator]
    for lo, hi, kind in _atoms(text, 0, len(text), limit - overlap, tokens, 0, n, 0):
        shared = overlap if groups and len(groups) > 1 else 0
        if groups and hi - groups[-1][0] + shared <= limit:
            groups[-1][1:] = [hi, kind]
        else:
            groups.append([lo, hi, kind])
    out = []
    for i, (lo, hi, kind) in enumerate(groups):
        first = max(0, lo - overlap) if i else 0
        end = tokens[groups[i + 1][0]][0] if i + 1 < len(groups) else len(text)
        start, own = (tokens[first][0], tokens[lo][0]) if i else (0, 0)
        out.append((i, start, own, end, kind if i + 1 < len(groups) else "end", hi - first, lo - first, text[start:end]))
    return out


def split_oversized(ldus: DataFrame, limit: int, overlap: int, key: str = "ldu_id", text: str = "content", most_chars: int = MOST_CHARS) -> DataFrame:
    """(key, *COLUMNS, unit_tokens) of the texts of more than limit tokens, each key once; smaller ones, null texts and null keys have no row.

    Tokens are counted as split() does; unit_tokens is the number of runs of non-space in the whole text. Small texts are
    left out by length and token count before Python sees them; a text is never cut across tasks, so there is no shuffle
    but the one that drops rows delivered again.
    """
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern))
    large = ldus.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_key IS NOT NULL").filter(F.length("_text") > limit).filter(count(rf"(?U)\S{{1,{most_chars}}}") > limit)
    large = large.groupBy("_key").agg(F.max("_text").alias("_text")).withColumn("_n", count(r"(?U)\S+"))

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(k, *p, n) for k, t, n in zip(pdf["_key"], pdf["_text"], pdf["_n"], strict=True) for p in split(t, limit, overlap, most_chars)]
            yield pd.DataFrame(rows, columns=["_key", *[c.split()[0] for c in COLUMNS.split(", ")], "unit_tokens"])

    kind = ldus.schema[key].dataType.simpleString()
    return large.mapInPandas(cut, f"_key {kind}, {COLUMNS}, unit_tokens int").withColumnRenamed("_key", key)


def rebuilt(pieces: DataFrame, key: str = "ldu_id") -> DataFrame:
    """(key, text): the texts back from their pieces, overlaps left out."""
    own = F.expr("substring(piece, cast(own_start - start + 1 as int))")
    return pieces.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_ix", own.alias("own")))), lambda x: x["own"]), "").alias("text"))
