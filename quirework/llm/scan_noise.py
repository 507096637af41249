"""Repair of text from scanned pages: divided words, misrecognised characters, running headers and page numbers.

A lexicon with frequencies is counted over all records. A symmetric-delete index over it gives correction candidates
(both sides drop characters until they meet), a weighted edit distance with confusion pairs ranks them, and counts of
neighbouring words choose between equals. Words and numbers are judged once by type, however often they occur, and only what is rare beside a word or number of
the lexicon within the cost is taken for a misreading; records are then scanned for the types found wrong, behind a
filter of bounded size, and joined to them exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.session import broadcast_if_small, materialize, spread

# What is printed and what is read for it.
CONFUSIONS = {("o", "0"), ("l", "1"), ("s", "5"), ("b", "8"), ("g", "9"), ("a", "@"), ("i", "!"), ("i", "í"), ("e", "c"), ("t", "f"), ("y", "v"), ("n", "ri"), ("u", "ii"), ("d", "cl"), ("h", "li"), ("m", "rn"), ("i", "l"), ("i", "1"), ("w", "vv"), ("z", "2")}
CONFUSED, OTHER, MOST_COST = 0.25, 1.0, 0.6
LEAST_COUNT, LEAST_RATIO, LEAST_LENGTH = 3, 3, 4
#: Shape of a line that may be a header or footer: one of a word or less is a number or a mark, a longer one is running text.
LINE_CHARS, LINE_WORDS = (8, 160), (2, 15)
#: Bits of the filter of types: BITS_A_TYPE each, within these bounds. Beyond them it only lets more through to the exact join.
LEAST_BITS, MOST_BITS, BITS_A_TYPE = 1 << 20, 1 << 26, 16
#: Share of the types with a letter in a number that must have it between digits, before the letter counts as a misread
#: digit at an edge too: a unit (10B) only stands last, a code (B12) only first.
EDGE_SHARE = 0.1

_TOKEN = re.compile(r"[^\s\"“”«»(),;:?….|*\[\]]+(?:\.(?=\d)[^\s\"“”«»(),;:?….|*\[\]]+)*")
_DIVIDED = re.compile("([\\w@!'’]*[\\w@!])[-­‐][^\\S\n]*\n\\s*([\\w@!]+)")
_HYPHEN = re.compile("([\\w@!'’]*[^\\W\\d_][\\w@!]*)[-­‐][^\\S\n]*(?:\n|$)")
_NEXT = re.compile(r"[\w@!]+")
_NUMBER = re.compile(r"(?=.*\d)(?=.*[OlISB])[-+$]?[\dOlISB]+(?:[.,/'-][\dOlISB]+)*%?$")
#: Where a mark or digit may stand for a letter: in a word, not in front of one as a number is.
_MARKED = re.compile(r"@|!(?=[^\W\d_])|í|[^\W\d_][01589](?=[^\W\d_]|[01589]*$|['’])|^[01589](?=[^\W\d_]{3})")
_N = r"[\dOlIS]{1,4}"
_PAGE = re.compile(rf"\s*(?:(?:page|p\.|pg\.?|seite|pagina|página)\s*\|?\s*{_N}(?:\s*(?:of|/|de|von)\s*{_N})?|[-–—]\s*{_N}\s*[-–—]|\[\s*{_N}\s*\]|{_N}|{_N}\s*/\s*{_N}|(?=[ivxl])x{{0,3}}(?:ix|iv|v?i{{0,3}})|(?=[IVXL])X{{0,3}}(?:IX|IV|V?I{{0,3}}))\s*$", re.I)
_EDGE_NUMBER = re.compile(rf"^\s*{_N}\s{{1,}}(?=[^\W\d_])|\s{{2,}}{_N}\s*$|\s+\|\s*{_N}\s*$|^\s*{_N}\s*\|\s*")
_PLAIN = str.maketrans("0158@!í9", "olsbaiig")
# The letters read for digits, and those digits.
_READ, _DIGIT = "OlISB", "01158"
_LETTERS = re.compile(r"[^\W\d_]+")
#: One form of every confusion, so that a line is the same however it was read.
_ALIKE = [("rn", "m"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("ri", "n"), ("vv", "w"), ("c", "e"), ("f", "t"), ("v", "y")]


def alike(line: str) -> str:
    """Letters of a line in lower case, every confusion in one form, page numbers at its edges left out."""
    text = _EDGE_NUMBER.sub("", line)
    words = []
    for w in text.lower().split():
        if sum(c.isalpha() for c in w) >= 2:
            w = w.translate(_PLAIN)
        words += _LETTERS.findall(w)
    out = " ".join(words)
    for a, b in _ALIKE:
        out = out.replace(a, b)
    return out


#: Two characters that are read as one.
_MERGED = {(b, a) for a, b in CONFUSIONS if len(b) == 2}
_PAIRS = {a for a, _ in _MERGED}


def distance(true: str, read: str, merged: bool = False) -> float:
    """Edit distance in which a confusion pair costs CONFUSED and anything else OTHER for each character; with merged, also two characters read as one are such a pair."""
    n, m = len(true), len(read)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                continue
            best = min(d[i - 1][j] + OTHER if i else 99.0, d[i][j - 1] + OTHER if j else 99.0)
            if i and j:
                best = min(best, d[i - 1][j - 1] + (0.0 if true[i - 1] == read[j - 1] else CONFUSED if (true[i - 1], read[j - 1]) in CONFUSIONS else OTHER))
                if j > 1 and (true[i - 1], read[j - 2 : j]) in CONFUSIONS:
                    best = min(best, d[i - 1][j - 2] + CONFUSED)
                if merged and i > 1 and (true[i - 2 : i], read[j - 1]) in _MERGED:
                    best = min(best, d[i - 2][j - 1] + CONFUSED)
            d[i][j] = best
    return d[n][m]


def tokens(text: str) -> list[str]:
    """Words and numbers of a text, words divided at a line end put together."""
    return _TOKEN.findall(_DIVIDED.sub(r"\1\2", text) if hyphened(text) else text)


def hyphened(text: str) -> bool:
    return "-" in text or "\u00ad" in text or "\u2010" in text


def marked(token: str) -> bool:
    """Whether the token has a digit or mark where a word has a letter. That alone is no misreading: a word of the lexicon must stand behind it."""
    if token.isalpha() and token.isascii() or token.isdigit():
        return False
    return _MARKED.search(token) is not None and sum(c.isalpha() for c in token) >= 3


def plain(token: str) -> set[str]:
    """The words a marked token may be read from: every mark as the letter it stands for."""
    return {token.translate(_PLAIN), token.replace("1", "i").translate(_PLAIN)} - {token}


_AROUND = "'’!-–—.%$<>{}=+&#~`_^/\\"


def word(token: str) -> str:
    return token.strip(_AROUND).lower()


def number(token: str) -> str | None:
    """The number a token is, misread letters and all; null for a word, or where letters outnumber the digits."""
    t = token.strip(_AROUND)
    if t.isdigit():
        return t
    if t[:1] in "0123456789OlISB" and _NUMBER.match(t) and sum(c.isdigit() for c in t) >= sum(c.isalpha() for c in t):
        return t
    return None


def form(token: str) -> str:
    """What a token is counted as: its number, else its word."""
    return number(token) or word(token)


def records(blocks: DataFrame, ldus: DataFrame) -> DataFrame:
    """(kind, id, doc_id, place, page, source, text) of both tables; null ids and texts are left out. Rows delivered again stay: results are distinct."""
    b = blocks.select(F.lit("block").alias("kind"), F.col("block_id").alias("id"), "doc_id", F.col("block_ix").alias("place"), F.col("page_number").alias("page"), "source", "text")
    u = ldus.select(F.lit("ldu").alias("kind"), F.col("ldu_id").alias("id"), "doc_id", F.col("ldu_ix").alias("place"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("source"), F.col("content").alias("text"))
    return spread(b.unionByName(u).filter("id IS NOT NULL AND length(text) > 0"))


#: ctx and key are of h: a hash of the two lines, and the second line as alike() has it where it may be a header.
_COLUMNS = ["what", "kind", "id", "a", "b", "page", "source", "n", "doc", "ctx", "key"]
_SCAN = "what string, kind string, id bigint, a string, b string, page int, source string, n bigint, doc string, ctx bigint, key string"


def _header_key(line: str) -> str | None:
    """The line as alike() has it if it may be a header or footer, else None: of LINE_CHARS and LINE_WORDS, no sentence, nothing that begins in small letters."""
    if not LINE_CHARS[0] <= len(line) <= LINE_CHARS[1] or "|" in line[1:-1] or (s := line.rstrip())[-1:] in ".?!;,:\"”»" or line[:1].islower():
        return None
    key = alike(s)
    return key if LINE_WORDS[0] <= key.count(" ") + 1 <= LINE_WORDS[1] else None


def _scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass: w(ord, count), n(umber, count), h(yphen: first and second part), l(ine that may be a header), f(urniture: page number)."""
    count: Counter[str] = Counter()
    for pdf in it:
        out: list[tuple] = []
        for kind, id_, doc, page, source, text in zip(pdf["kind"], pdf["id"], pdf["doc_id"], pdf["page"], pdf["source"], pdf["text"], strict=True):
            page = None if page is None or page != page else int(page)
            if hyphened(text):
                for m in _HYPHEN.finditer(text):
                    line = text[m.end() :].split("\n", 1)[0]
                    nxt = None if _PAGE.match(line) else _NEXT.match(line.lstrip())
                    ctx = xxhash.xxh3_64_intdigest(text[text.rfind("\n", 0, m.start()) + 1 : m.end()] + "\n" + line) - (1 << 63)
                    out.append(("h", kind, id_, word(m.group(1)), word(nxt.group()) if nxt else None, page, "U" if m.group(1)[:1].isupper() else None, 1, doc, ctx, _header_key(line)))
            for line in text.split("\n"):
                if _page_number(line):
                    out.append(("f", kind, id_, None, None, page, None, 1, None, None, None))
                elif (key := _header_key(line)) is not None:
                    out.append(("l", kind, id_, doc, key, page, source, 1, None, None, None))
            count.update(tokens(text))
        if len(count) > 300_000:
            out += _clean(count)
            count.clear()
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"id": "Int64", "page": "Int32", "ctx": "Int64"})
    if count:
        yield pd.DataFrame(_clean(count), columns=_COLUMNS).astype({"id": "Int64", "page": "Int32", "ctx": "Int64"})


def _clean(count: Counter) -> list[tuple]:
    """Rows of w and n by word and number: surrounding marks off, nothing of one character."""
    words_: Counter[str] = Counter()
    numbers: Counter[str] = Counter()
    for t, n in count.items():
        if (x := number(t)) is not None:
            numbers[x] += n
        elif len(w := word(t)) > 1 and any(c.isalpha() for c in w):
            words_[w] += n
    return [(what, None, None, w, None, None, None, n, None, None, None) for what, found in (("w", words_), ("n", numbers)) for w, n in found.items()]


def _page_number(line: str) -> bool:
    return _PAGE.match(line) is not None and bool(line) and not line.isspace()


def scan(recs: DataFrame) -> DataFrame:
    """What one pass over all records finds, kept in the shared folder."""
    return materialize(recs.mapInPandas(_scan, _SCAN), "scan")


def lexicon(found: DataFrame) -> DataFrame:
    """(word, n): words of all records with their counts, halves of divided words put together."""
    return found.filter("what = 'w'").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"))


def _drops(w: str, pairs: bool) -> set[str]:
    """w with two neighbouring characters dropped: any two, or only those that may be read as one."""
    return {w[:i] + w[i + 2 :] for i in range(len(w) - 1) if not pairs or w[i : i + 2] in _PAIRS}


def _deletes(index: bool):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for w, n in zip(pdf["word"], pdf["n"], strict=True):
                keys = {w[:i] + w[i + 1 :] for i in range(len(w))} | _drops(w, index)
                if not index:
                    keys.add(w)
                    if marked(w):
                        keys |= {p[:i] + p[i + 1 :] for p in plain(w) for i in range(len(p))}
                out += [(xxhash.xxh3_64_intdigest(k) - (1 << 63), w, n) for k in keys]
            yield pd.DataFrame(out, columns=["k", "word", "n"])

    return run


def corrections(lex: DataFrame, least_count: int = LEAST_COUNT, ratio: float = LEAST_RATIO, most_cost: float = MOST_COST, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(read, true, cost, n_true): candidates for words that are rare beside a word they can be misread from.

    Words of fewer than least_length characters are not judged: nearly every one lies within the cost of another. The index
    holds the words seen at least least_count times with one character dropped, or two that may be read as one (rn as m); a word is looked up with one
    or two neighbouring characters dropped, a marked one also with its marks as letters. As a digit or mark within a word
    is a sign by itself, such a word may be as frequent as the word behind it; the letter í is none, for languages write it.
    """
    long = lex.filter(F.length("word") >= least_length)
    true = long.filter(F.col("n") >= least_count).filter(~F.col("word").rlike("[0-9@!]")).mapInPandas(_deletes(True), "k bigint, word string, n bigint").select("k", F.col("word").alias("true"), F.col("n").alias("n_true"))
    read = long.mapInPandas(_deletes(False), "k bigint, word string, n bigint").select("k", F.col("word").alias("read"), "n")
    near = read.join(true, "k").filter((F.col("read") != F.col("true")) & (F.col("n_true") >= ratio * F.col("n"))).select("read", "true", "n_true").distinct()

    def weigh(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf["cost"] = [distance(a, b, merged=True) for a, b in zip(pdf["true"], pdf["read"], strict=True)]
            yield pdf[pdf["cost"] <= most_cost]

    def letters(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(p, w, n, CONFUSED * sum(a != b for a, b in zip(p, w, strict=True)), w.translate(_DIACRITIC) == p) for w, n in zip(pdf["word"], pdf["n"], strict=True) if marked(w) for p in plain(w)]
            yield pd.DataFrame(rows, columns=["word", "read", "n_read", "cost", "only_i"])

    signs = long.filter(F.col("word").rlike("[0-9@!í]")).mapInPandas(letters, "word string, read string, n_read bigint, cost double, only_i boolean")
    behind = signs.join(lex, "word").filter(F.when(F.col("only_i"), (F.col("n") >= least_count) & (F.col("n") >= ratio * F.col("n_read"))).otherwise(F.col("n") >= F.col("n_read")))
    both = near.mapInPandas(weigh, "read string, true string, n_true bigint, cost double").unionByName(behind.select("read", F.col("word").alias("true"), F.col("n").alias("n_true"), "cost"))
    return both.groupBy("read", "true").agg(F.max("n_true").alias("n_true"), F.min("cost").alias("cost"))


_DIACRITIC = str.maketrans("í", "i")


def number_corrections(found: DataFrame, least_count: int = LEAST_COUNT, ratio: float = LEAST_RATIO, edge_share: float = EDGE_SHARE) -> DataFrame:
    """(read, true, cost, n_true): numbers with letters in them that are rare beside the number with the digits in their place.

    As every row of digits is a number, one whose letters all stand between digits may also be rare by itself (fewer than least_count).
    A letter at an edge is also a unit (10B) or a code (B12). It is judged only if edge_share of the letter's types at least have it
    between digits, as a misread digit stands anywhere.
    """
    counted = found.filter("what = 'n'").groupBy("a").agg(F.sum("n").alias("n"))
    read = counted.filter(F.col("a").rlike(f"[{_READ}]")).select(F.col("a").alias("read"), F.col("n").alias("n_read"))
    true = counted.filter(~F.col("a").rlike(f"[{_READ}]")).select(F.col("a").alias("true"), F.col("n").alias("n_true"))
    at = lambda i: F.when(i == 1, "first").when(i == F.length("read"), "last").otherwise("inner")
    places = read.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("read")), lambda i: F.struct(F.substring("read", i, F.lit(1)).alias("c"), at(i).alias("at")))).alias("x")).filter(F.col("x.c").rlike(f"[{_READ}]"))
    # A row a letter and place: fifteen at most.
    types: dict[str, Counter] = {}
    for r in places.groupBy("x.c", "x.at").agg(F.count("*").alias("n")).collect():
        types.setdefault(r["c"], Counter())[r["at"]] += r["n"]
    sure = "".join(c for c in _READ if c in types and types[c]["inner"] >= max(1, edge_share * types[c].total()))
    unsure = "".join(c for c in _READ if c not in sure)
    pairs = read.withColumn("true", F.translate("read", _READ, _DIGIT)).join(true, "true", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    inner = (F.col("n_read") < least_count) & F.col("read").rlike(r"^[0-9].*[0-9]$") & ~F.col("read").rlike(f"[{_READ}][^0-9{_READ}]|[^0-9{_READ}][{_READ}]")
    pairs = pairs.filter((F.col("n_true") >= ratio * F.col("n_read")) | inner)
    if unsure:
        pairs = pairs.filter(~F.col("read").rlike(f"^[{unsure}]|[{unsure}]$"))
    return pairs.select("read", "true", "n_true", (CONFUSED * F.length(F.regexp_replace("read", f"[^{_READ}]", ""))).alias("cost"))


def _filter(types: DataFrame, column: str) -> bytes:
    """A bitmap with the hash of every type set: BITS_A_TYPE bits a type, a power of two within LEAST_BITS and MOST_BITS."""
    bits, n = LEAST_BITS, types.count()
    while bits < min(MOST_BITS, BITS_A_TYPE * n):
        bits *= 2
    at = F.pmod(F.crc32(column), F.lit(bits)).cast("long")
    out = bytearray(bits // 8)
    for r in types.select(at.alias("p")).groupBy(F.floor(F.col("p") / 32768).alias("b")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("m")).toLocalIterator():
        out[int(r["b"]) * 4096 : int(r["b"]) * 4096 + 4096] = bytes(r["m"])
    return bytes(out)


def occurrences(recs: DataFrame, types: DataFrame, column: str = "read") -> DataFrame:
    """(kind, id, column) of the records that hold one of the types: a pass behind a bitmap, then an exact join."""
    import zlib

    bits = _filter(types.select(column).distinct(), column)

    def look(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, crc, known = 8 * len(bits), zlib.crc32, {}

        def test(t: str) -> str | None:
            w = form(t)
            p = crc(w.encode()) % size
            return w if bits[p >> 3] >> (p & 7) & 1 else None

        for pdf in it:
            if len(known) > 500_000:
                known.clear()
            out = []
            for kind, id_, text in zip(pdf["kind"], pdf["id"], pdf["text"], strict=True):
                for t in set(tokens(text)):
                    if t in known:
                        w = known[t]
                    else:
                        w = known[t] = test(t)
                    if w is not None:
                        out.append((kind, id_, w))
            yield pd.DataFrame(out, columns=["kind", "id", column])

    hits = recs.select("kind", "id", "text").mapInPandas(look, f"kind string, id bigint, {column} string")
    return hits.join(types.select(column).distinct(), column, "left_semi")


def divided_words(recs: DataFrame, found: DataFrame, lex: DataFrame, fixes: DataFrame, compound_records: int = 3) -> DataFrame:
    """(kind, id, a, b) of words divided at a line end or the end of the record (b is null there).

    Not divided: a compound, that is, two parts that stand divided in at least compound_records different pairs of lines
    though, put together, they are no more frequent in the text than those divisions and are no misreading of a word. As
    accidents grow with the corpus, the first part must also be divided no more often in words, or be itself a word that is more frequent
    than that; and a number, a running header or a repeated line is no second part. A part before such a line, or at the end of
    the record, is judged with its continuation, the next word of the file; one that has none and begins a compound is left out.
    """
    headers = _headers(found).select(F.col("doc_id").alias("doc"), "key")
    h = found.filter("what = 'h'").select("kind", "id", "a", "b", F.col("source").isNotNull().alias("name"), "ctx", "doc", "key")
    cut = F.col("stop").isNotNull() | F.col("b").rlike("^[0-9]")
    pairs = h.join(headers.withColumn("stop", F.lit(True)), ["doc", "key"], "left").withColumn("b", F.when(~F.coalesce(cut, F.lit(False)), F.col("b")))
    whole = F.concat("a", "b")
    counted = pairs.filter("b IS NOT NULL").groupBy("a", "b").agg(F.countDistinct("ctx").alias("contexts"), F.count("*").alias("times"), F.max("name").alias("any_name"))
    joined = counted.withColumn("word", whole).join(lex, "word", "left").join(fixes.select(F.col("read").alias("word"), F.lit(True).alias("misread")).distinct(), "word", "left")
    joined = joined.withColumn("rare", (F.coalesce("n", F.lit(0)) <= F.col("times") * 2) & F.col("misread").isNull()).select("a", "b", "contexts", "times", "any_name", "rare")
    ends = pairs.filter("b IS NULL").groupBy("a").agg(F.count("*").alias("ends"))
    # How often the first part is divided in words, and how often it stands by itself.
    in_words = joined.groupBy("a").agg(F.sum(F.when(F.col("rare"), 0).otherwise(F.col("times"))).alias("in_words")).join(ends, "a", "left").join(lex.select(F.col("word").alias("a"), F.col("n").alias("alone")), "a", "left")
    stems = in_words.select("a", (F.col("in_words") + F.coalesce("ends", F.lit(0))).alias("stem"), (F.coalesce("alone", F.lit(0)) - F.coalesce("ends", F.lit(0))).alias("alone"))
    likely = joined.filter((F.col("contexts") >= compound_records) & ~F.col("any_name") & F.col("rare"))
    compound = materialize(likely.join(stems, "a").filter((F.col("times") >= F.col("stem")) | (F.col("alone") > F.col("stem"))).select("a", "b"), "compounds")
    inside = pairs.filter("b IS NOT NULL").join(compound, ["a", "b"], "left_anti").select("kind", "id", "a", "b")
    first = compound.select("a").distinct()
    last = pairs.filter("b IS NULL").select("kind", "id", "a", "b")
    unsure = last.join(first, "a", "left_semi")
    other = _continued(recs, unsure, headers).filter("b IS NOT NULL").join(compound, ["a", "b"], "left_anti").select("kind", "id", "a", F.lit(None).cast("string").alias("b"))
    return inside.unionByName(last.join(first, "a", "left_anti").select("kind", "id", "a", "b")).unionByName(other)


def _continued(recs: DataFrame, unsure: DataFrame, headers: DataFrame) -> DataFrame:
    """(kind, id, a, b) of first parts (kind, id, a): with the word that follows in the record or else in the file, page numbers and headers (doc, key) passed over; null where the file ends."""
    wanted = unsure.groupBy("kind", "id").agg(F.collect_set("a").alias("parts"))
    files = recs.select("kind", "id", "doc_id").join(wanted.select("kind", "id"), ["kind", "id"], "left_semi").select("kind", "doc_id").distinct()
    keys = headers.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("key").alias("running"))
    rows = recs.select("kind", "id", "doc_id", "place", "text").join(files, ["kind", "doc_id"], "left_semi").dropDuplicates(["kind", "id"]).join(keys, "doc_id", "left").join(wanted, ["kind", "id"], "left")

    def look(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for kind, id_, doc, place, text, running, parts in zip(pdf["kind"], pdf["id"], pdf["doc_id"], pdf["place"], pdf["text"], pdf["running"], pdf["parts"], strict=True):
                skip = set() if running is None else set(running)
                kept = "\n".join(x for x in text.split("\n") if x.strip() and not _page_number(x) and not (skip and _header_key(x) in skip))
                start = _NEXT.search(kept)
                cuts = []
                for m in _HYPHEN.finditer(kept) if parts is not None else ():
                    if word(m.group(1)) in parts:
                        nxt = _NEXT.search(kept, m.end())
                        cuts.append({"a": word(m.group(1)), "b": word(nxt.group()) if nxt else None})
                out.append((kind, id_, doc, place, word(start.group()) if start else None, cuts))
            yield pd.DataFrame(out, columns=["kind", "id", "doc_id", "place", "start", "cuts"]).astype({"place": "Int32"})

    seen = rows.mapInPandas(look, "kind string, id bigint, doc_id string, place int, start string, cuts array<struct<a:string,b:string>>")
    return following(materialize(seen, "starts"), "start", F.size("cuts") > 0).select("kind", "id", "next", F.explode("cuts").alias("c")).select("kind", "id", "c.a", F.coalesce("c.b", "next").alias("b"))


def following(rows: DataFrame, value: str, wanted: Column, span: int = 64) -> DataFrame:
    """The wanted rows of rows (kind, id, doc_id, place) with next: the first value that is not null after each row in the order of place, then id, within its file; rows without place come last, and wanted rows without doc_id are left out.

    In stretches of span places: within each that has a wanted row, then over the stretches, so that a file of any size is never one window.
    """
    at = F.coalesce(F.col("place").cast("bigint"), F.col("id"))
    placed = rows.withColumn("_part", F.struct(F.col("place").isNull().alias("last"), F.floor(at / span).alias("n"))).withColumns({"_at": F.struct(at.alias("at"), "id"), "_want": F.coalesce(wanted, F.lit(False))})
    parts = broadcast_if_small(placed.filter("_want").select("kind", "doc_id", "_part").distinct(), 200_000)
    back = lambda key, order: Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.join(parts, ["kind", "doc_id", "_part"], "left_semi").withColumn("_near", F.last(value, ignorenulls=True).over(back(["kind", "doc_id", "_part"], ["_at"])))
    heads = placed.groupBy("kind", "doc_id", "_part").agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_head"))
    heads = heads.withColumn("_far", F.last("_head", ignorenulls=True).over(back(["kind", "doc_id"], ["_part"]))).drop("_head")
    return within.filter("_want").join(heads, ["kind", "doc_id", "_part"], "left").withColumn("next", F.when(F.col("doc_id").isNotNull(), F.coalesce("_near", "_far"))).drop("_part", "_at", "_near", "_far", "_want")


def _lines(found: DataFrame, least_pages: int, least_files: int, least_share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines that may be headers, those recurring on pages of their file (doc_id, key, source), those repeated across the files of the source (source, key)."""
    lines = found.filter("what = 'l'").select("kind", "id", F.col("a").alias("doc_id"), F.col("b").alias("key"), "page", "source")
    on = lines.filter("kind = 'block' AND doc_id IS NOT NULL AND page IS NOT NULL")
    recurring = on.groupBy("doc_id", "key", "source", "page").agg(F.count("*").alias("c")).groupBy("doc_id", "key", "source").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    files = on.groupBy("source", "key", "doc_id").agg(F.count("*").alias("c")).groupBy("source", "key").agg(F.count("*").alias("files")).filter(F.col("files") >= least_files)
    sizes = on.select("source", "doc_id").distinct().groupBy("source").agg(F.count("*").alias("all"))
    common = files.join(sizes, "source").filter(F.col("files") >= least_share * F.col("all")).select("source", "key")
    return lines, recurring, common


def running_lines(found: DataFrame, least_pages: int = 2, least_files: int = 3, least_share: float = 0.2) -> DataFrame:
    """(kind, id, doc_id, key): lines that recur on least_pages pages of their file, but not those repeated across the files of the source."""
    lines, recurring, common = _lines(found, least_pages, least_files, least_share)
    kept = recurring.join(common, ["source", "key"], "left_anti").select("doc_id", "key").distinct()
    return lines.join(kept, ["doc_id", "key"], "left_semi").select("kind", "id", "doc_id", "key")


def _headers(found: DataFrame, least_pages: int = 2, least_files: int = 3, least_share: float = 0.2) -> DataFrame:
    """(doc_id, key): lines of each file that stand between the halves of a word: running lines and repeated ones."""
    lines, recurring, common = _lines(found, least_pages, least_files, least_share)
    repeated = lines.filter("doc_id IS NOT NULL").select("doc_id", "key", "source").join(common, ["source", "key"], "left_semi").select("doc_id", "key")
    return materialize(recurring.select("doc_id", "key").unionByName(repeated).distinct(), "headers")


def defects(blocks: DataFrame, ldus: DataFrame) -> DataFrame:
    """(record_kind, record_id, defect), distinct: hyphen, misread and furniture of every block and LDU."""
    recs = records(blocks, ldus)
    found = scan(recs)
    lex = materialize(lexicon(found), "lexicon")
    fixes = materialize(corrections(lex).unionByName(number_corrections(found)), "fixes")
    parts = [
        divided_words(recs, found, lex, fixes).select("kind", "id", F.lit("hyphen").alias("defect")),
        occurrences(recs, fixes).select("kind", "id", F.lit("misread").alias("defect")),
        found.filter("what = 'f'").select("kind", "id", F.lit("furniture").alias("defect")),
        running_lines(found).select("kind", "id", F.lit("furniture").alias("defect")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), "defect")


def _context(recs: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(prev, true, seen): how often a candidate of an ambiguous word follows another word, counted over all records."""
    import zlib

    bits = _filter(ambiguous.select("true").distinct(), "true")

    def look(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter[tuple[str, str]] = Counter()
        for pdf in it:
            for text in pdf["text"]:
                ws = [form(t) for t in tokens(text)]
                for a, b in zip(ws, ws[1:], strict=False):
                    p = zlib.crc32(b.encode()) % (8 * len(bits))
                    if bits[p >> 3] >> (p & 7) & 1:
                        count[a, b] += 1
            if len(count) > 200_000:
                yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["prev", "true", "seen"])
                count.clear()
        yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["prev", "true", "seen"])

    return recs.select("text").mapInPandas(look, "prev string, true string, seen bigint").groupBy("prev", "true").agg(F.sum("seen").alias("seen"))


def _apply(text: str, running: list[str], fixes: dict[str, str]) -> str:
    """One record repaired: furniture left out, words put together and corrected, lines joined to paragraphs."""
    skip = set(running)
    kept = [x for x in text.split("\n") if not _page_number(x) and not (skip and alike(x.rstrip()) in skip)]
    out = "\n".join(kept)
    if hyphened(out):
        out = _DIVIDED.sub(lambda m: m.group(1) + ("-" if (word(m.group(1)) + "-" + word(m.group(2))) in fixes else "") + m.group(2), out)

    def fix(m: re.Match) -> str:
        t = m.group()
        w = form(t)
        if fixes.get(w):
            new = fixes[w]
            if number(t):
                return t.replace(w, new)
            if t[:1].isupper() or (len(t) > 1 and t[1:2].isupper()):
                new = new.upper() if t.upper() == t and len(t) > 1 and t[1:].upper() == t[1:] and any(c.isalpha() for c in t[1:]) else new[:1].upper() + new[1:]
            at = t.lower().find(w)
            return t[:at] + new + t[at + len(w) :]
        return t

    lines = _TOKEN.sub(fix, out)
    listed = re.compile(r"\s*(?:[*•|-]|\d+[.)])\s")
    paragraphs: list[str] = []
    for line in lines.split("\n"):
        if paragraphs and line.strip() and not listed.match(line):
            paragraphs[-1] = paragraphs[-1].rstrip() + " " + line.strip()
        elif line.strip():
            paragraphs.append(line.strip())
    return "\n".join(paragraphs)


def repaired(blocks: DataFrame, ldus: DataFrame) -> DataFrame:
    """(record_kind, record_id, doc_id, place, page, text): every block and LDU once as readable paragraphs, in the order of place within doc_id.

    Records of nothing but furniture are left out. A word divided at the end of a record is completed from the next record
    that has text, which loses that part; rows without place come last in their file, and none without doc_id is completed. A word or
    number is changed only if the lexicon has the one it was read from. One row a record: no file is gathered in one task.
    """
    recs = records(blocks, ldus).dropDuplicates(["kind", "id"])
    found = scan(recs)
    lex = materialize(lexicon(found), "lexicon")
    candidates = materialize(corrections(lex).unionByName(number_corrections(found)), "fixes")
    best = candidates.groupBy("read").agg(F.min("cost").alias("low"))
    close = candidates.join(best, "read").filter(F.col("cost") <= F.col("low") + 1e-9)
    many = close.groupBy("read").agg(F.count("*").alias("c")).filter("c > 1").select("read")
    hits = occurrences(recs, candidates)
    plain = close.groupBy("read").agg(F.max_by("true", F.struct("n_true", "true")).alias("true"))
    # Of several equally near candidates the one seen most after the same word before; else the most frequent.
    ambiguous = close.join(many, "read", "left_semi")
    before = recs.join(hits.join(many, "read", "left_semi").select("kind", "id").distinct(), ["kind", "id"], "left_semi")

    def neighbours(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for kind, id_, text in zip(pdf["kind"], pdf["id"], pdf["text"], strict=True):
                ws = [form(t) for t in tokens(text)]
                out += [(kind, id_, a, b) for a, b in zip(ws, ws[1:], strict=False)]
            yield pd.DataFrame(out, columns=["kind", "id", "prev", "read"])

    pairs = before.select("kind", "id", "text").mapInPandas(neighbours, "kind string, id bigint, prev string, read string").join(ambiguous, "read")
    chosen = pairs.join(_context(recs, ambiguous), ["prev", "true"]).groupBy("kind", "id", "read").agg(F.max_by("true", F.struct("seen", "n_true", "true")).alias("by_context"))
    fixed = hits.join(plain, "read").join(chosen, ["kind", "id", "read"], "left").select("kind", "id", "read", F.coalesce("by_context", "true").alias("true"))
    divided = materialize(divided_words(recs, found, lex, candidates), "divided")
    compound = found.filter("what = 'h' AND b IS NOT NULL").select("kind", "id", "a", "b").join(divided.select("kind", "id", "a", "b"), ["kind", "id", "a", "b"], "left_anti").select("kind", "id", F.concat_ws("-", "a", "b").alias("read"), F.lit("").alias("true"))
    maps = fixed.unionByName(compound).distinct().groupBy("kind", "id").agg(F.map_from_entries(F.collect_set(F.struct("read", "true"))).alias("fixes"))
    lines = running_lines(found).groupBy("kind", "id").agg(F.collect_set("key").alias("running"))
    work = recs.join(maps, ["kind", "id"], "left").join(lines, ["kind", "id"], "left")

    def mend(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf["text"] = [_apply(t, [] if r is None else list(r), {} if m is None else dict(m)) for t, r, m in zip(pdf["text"], pdf["running"], pdf["fixes"], strict=True)]
            yield pdf[["kind", "id", "doc_id", "place", "page", "text"]]

    mended = materialize(work.select("kind", "id", "doc_id", "place", "page", "text", "running", "fixes").mapInPandas(mend, "kind string, id bigint, doc_id string, place int, page int, text string").filter("text <> ''"), "mended")
    open_end = divided.filter("b IS NULL").select("kind", "id").distinct().withColumn("cut", F.lit(True))
    firsts = mended.join(open_end, ["kind", "id"], "left").select("kind", "id", "doc_id", "place", F.struct(F.col("id").alias("to"), F.regexp_extract("text", r"^(\w+)", 1).alias("part")).alias("first"), (F.col("cut") & F.col("text").rlike(r"\w[-­‐]$")).alias("cut"))
    nxt = following(materialize(firsts, "firsts"), "first", F.col("cut")).select("kind", F.col("id").alias("from"), "next.to", "next.part").filter("part <> ''")
    mended = mended.join(nxt.select("kind", F.col("from").alias("id"), "part"), ["kind", "id"], "left").join(nxt.groupBy("kind", F.col("to").alias("id")).agg(F.max("part").alias("gone")), ["kind", "id"], "left")
    text = F.when(F.col("part").isNotNull(), F.concat(F.regexp_replace("text", r"[-­‐]$", ""), "part")).otherwise(F.col("text"))
    text = F.when(F.col("gone").isNotNull(), F.ltrim(F.substring(text, F.length("gone") + 1, F.length(text)))).otherwise(text)
    return mended.select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), "doc_id", "place", "page", text.alias("text"))
