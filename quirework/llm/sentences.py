"""Sentence boundaries across languages and scripts.

Every place where a sentence can end (a terminator with its closing marks, or any space beside a script that writes no
terminators) is tagged boundary or inside by a linear-chain model and Viterbi decoding. The model needs no labelled
boundaries: it is trained where the text shows them itself. Paragraphs of a bounded sample are joined by a space; a
joint is a sure boundary, every other place is unlabelled. A logistic model of "is a joint" gives g(x); as joints
look like any other boundary, P(boundary | x) = g(x) / c, where c is the mean of g over the joints of a script
(learning from positive and unlabelled cases). Paragraphs in a script without terminators are stripped of what
terminators they have before they are joined, so the model learns which words begin and end sentences there. Transitions
are estimated from the decoded sample. The sample is drawn by a hash of the key, so that it is the same in any order of files.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.session import spread

#: Bounds of the training sample: texts in all, texts more of each script, texts of a language of the labelled samples, and
#: the texts (times SAMPLE) whose scripts are looked at.
SAMPLE, SAMPLE_SCRIPT, SAMPLE_LABELLED, POOL = 3000, 400, 200, 20
#: Share of c from which an unlabelled place counts as a boundary while the model learns.
FROM = 0.4

# Terminators, closing marks and quotation marks by script.
FREE_END = "。！？｡"
BARE = "฀-๿຀-໿ក-៿က-႟"
CLOSE = "\"”»'’)\\]」』“›"
_BULLET = re.compile(r"[^\S\n]*(?:[*•‣▪◦·–—-]|\(?\d{1,3}[.)]|\(?[a-z][.)])[^\S\n]+\S")
_PARAGRAPH = re.compile("\n[^\\S\n]*(?:\n[^\\S\n]*)+|[  \f]+")
_QUOTE = re.compile(r"\"[^\"]*\"|«[^»]*»|“[^”]*”|„[^“”]*[“”]|「[^」]*」|『[^』]*』|‹[^›]*›")
_ENDING = re.compile(rf"[.!?…؟۔።।॥:{FREE_END}]+(?:[{CLOSE}]|[^\S\n][»›])*")
_SPACE = re.compile(rf"(?<=[{BARE}])\s+|\s+(?=[{BARE}])|(?<=\d)\s+(?=[A-ZÀ-ÞА-Я])")
_STRONG = frozenset("።।॥؟" + FREE_END)
#: Terminators before a space or the end, closing marks between: what is stripped where a script writes none.
_WRITTEN = re.compile(rf"[.!?…؟۔።।॥{FREE_END}]+(?=[{CLOSE}]*(?:\s|$))")
_BARE = re.compile(f"[{BARE}]")
_TERM = re.compile(r"(?:[.!?…؟።۔।॥。！？｡]|::)+")
_DIGITS = re.compile(r"\d+")

_RANGES = [(0x30, 0x39, "9"), (0x41, 0x24F, "L"), (0x370, 0x3FF, "G"), (0x400, 0x52F, "C"), (0x590, 0x5FF, "B"), (0x600, 0x6FF, "A"), (0x900, 0x97F, "D"), (0xE00, 0xE7F, "T"), (0xE80, 0xEFF, "O"), (0x1000, 0x109F, "M"), (0x1200, 0x139F, "E"), (0x1780, 0x17FF, "R"), (0x3040, 0x30FF, "J"), (0x3400, 0x9FFF, "H"), (0xAC00, 0xD7AF, "K")]


def _script_of(ch: str) -> str:
    o = ord(ch)
    for lo, hi, name in _RANGES:
        if lo <= o <= hi:
            return name
    return "x"


def _kind_of(ch: str) -> str:
    if ch.isupper():
        return "U"
    if ch.islower():
        return "l"
    if ch.isdigit():
        return "9"
    return _script_of(ch) if ch.isalpha() else ("q" if ch in "\"“„«「『¿¡(" else "x")


class _Memo(dict):
    """A function of a short string, remembered."""

    def __init__(self, f):
        self.f = f

    def __missing__(self, key):
        self[key] = out = self.f(key)
        return out


_SCRIPT, _KIND = _Memo(_script_of), _Memo(_kind_of)


def script(ch: str) -> str:
    return _SCRIPT[ch]


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is_list_line) of every paragraph and every line of a list, without the space around them.

    A paragraph whose first line has a bullet is a list; each of its lines with a bullet begins an item.
    """
    at = 0
    ends = [m.span() for m in _PARAGRAPH.finditer(text)]
    for end, after in [*ends, (len(text), len(text))]:
        part = text[at:end]
        if _BULLET.match(part):
            lines = [m.start() for m in re.finditer(r"^", part, re.M) if m.start() == 0 or _BULLET.match(part, m.start())]
            spans = [(at + a, at + b, True) for a, b in zip(lines, [*lines[1:], len(part)], strict=True)]
        else:
            spans = [(at, end, False)]
        for a, b, listed in spans:
            piece = text[a:b]
            lead = len(piece) - len(piece.lstrip())
            if lead < len(piece):
                yield a + lead, a + len(piece.rstrip()), listed
        at = after


def _bare_near(paragraph: str, a: int, b: int) -> bool:
    """Whether a space lies beside a script without terminators, numbers in between aside."""
    if _BARE.match(paragraph, b):
        return True
    before = paragraph[max(0, a - 24) : a].rstrip("0123456789., ")
    return _BARE.match(before[-1:]) is not None


def candidates(paragraph: str) -> list[tuple[int, int, bool]]:
    """(start, end, inside_quotation) of the places where a sentence of the paragraph may end; a quotation left open hides nothing."""
    found, n = [], len(paragraph)
    for m in _ENDING.finditer(paragraph):
        a, b = m.span()
        if paragraph[a] == ":" and paragraph[a : a + 2] != "::":
            continue
        if b < n and not (nxt := paragraph[b]).isspace() and _STRONG.isdisjoint(m.group()):
            # No space after the terminator: only where a new word can begin.
            if not (a and (last := paragraph[a - 1]).isalpha() and not last.isupper() and nxt.isalpha() and (nxt > "\u052f" or nxt.isupper() and paragraph[b + 1 : b + 2].isalpha())):
                continue
        found.append((a, b))
    if _BARE.search(paragraph):
        ends = {b for _, b in found}
        found = sorted(found + [m.span() for m in _SPACE.finditer(paragraph) if m.start() not in ends and _bare_near(paragraph, *m.span())])
    if not found:
        return []
    quotes = [m.span() for m in _QUOTE.finditer(paragraph)] if any(c in paragraph for c in "\"«“„「『‹") else []
    out, k = [], 0
    for a, b in found:
        while k < len(quotes) and quotes[k][1] <= a:
            k += 1
        inside = k < len(quotes) and quotes[k][0] < a and b < quotes[k][1]
        out.append((a, b, inside))
    return out


def features(before: str, mark: str, after: str) -> list[str]:
    """Of one place: at most 24 characters before, the mark with closers, at most 16 characters after (space removed)."""
    term = "" if mark.isspace() else _TERM.match(mark).group()
    closers = mark[len(term) :].strip()
    prev = before.rsplit(None, 1)[-1] if before and not before[-1].isspace() else ""
    last, first = (before[-1:] or "^"), (after[:1] or "$")
    following = after.split(None, 1)[0] if after else ""
    kp, kn = _SCRIPT[last] if last != "." else ".", _KIND[first]
    word = _DIGITS.sub("9", prev[-24:].lower())
    shape = ("9" if prev[-1:].isdigit() else "w") + str(min(len(prev), 5)) + ("." if "." in prev else "") + ("U" if prev[:1].isupper() else "")
    nxt = _DIGITS.sub("9", following)
    out = [f"T{term}{kp}", f"P{word[-10:]}{term}", f"n{term}{kn}", f"s{term}{shape}", f"sn{term}{shape}{kn}", f"C{closers}{kn}", f"kk{kp}{kn}{term}"]
    if kn in "THJKOMRE" or kp in "TOMR":
        out += [f"N{nxt[:6]}", f"N{nxt[:3]}", f"N{nxt[:10]}", f"S{word[-3:]}", f"S{word[-6:]}"]
    else:
        out += [f"N{nxt[:8]}", f"PN{word[-10:]}{kn}"]
    return out


class Model:
    """Weights by feature, c by script, transitions; plain data, so that it travels to the executors with the function."""

    def __init__(self, weights: dict[str, float], bias: float, c: dict[str, float], moves: list[list[float]]):
        self.weights, self.bias, self.c, self.moves = weights, bias, c, moves
        self.known: dict[tuple[str, str, str], float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def odds(self, before: str, mark: str, after: str) -> float:
        """_odds, remembered by the two tokens."""
        prev = "" if before[-1:].isspace() else before.rsplit(None, 1)[-1] if before else ""
        key = (prev, mark, after.split(None, 1)[0] if after else "")
        z = self.known.get(key)
        if z is None:
            if len(self.known) > 500_000:
                self.known.clear()
            z = self.known[key] = self._odds(before, mark, after)
        return z

    def _odds(self, before: str, mark: str, after: str) -> float:
        """log P(boundary) - log P(inside)."""
        z = self.bias
        for f in features(before, mark, after):
            z += self.weights.get(f, 0.0)
        p = (1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) / self.c.get(_script_key(before, mark), self.c["*"])
        p = min(max(p, 1e-4), 1 - 1e-4)
        return math.log(p / (1 - p))

    def tags(self, para: str, places: list[tuple[int, int, bool]]) -> list[bool]:
        odds, at = [], 0
        for s, e, no in places:
            odds.append(-30.0 if no else self.odds(para[max(at, s - 24) : s], para[s:e], para[e : e + 20].lstrip()[:16]))
            at = e
        return self.decode(odds, [p[2] for p in places])

    def decode(self, odds: list[float], blocked: list[bool]) -> list[bool]:
        """Viterbi over the places of one paragraph; a blocked place (in a quotation) is inside."""
        if not odds:
            return []
        (ii, ib), (bi, bb) = self.moves
        inside, boundary, back = 0.0, -math.inf, []
        for z, no in zip(odds, blocked, strict=True):
            to_i = (inside + ii, False) if inside + ii >= boundary + bi else (boundary + bi, True)
            to_b = (inside + ib, False) if inside + ib >= boundary + bb else (boundary + bb, True)
            back.append((to_i[1], to_b[1]))
            inside, boundary = to_i[0], (-math.inf if no else to_b[0] + z)
        tags, tag = [], boundary > inside
        for frm in reversed(back):
            tags.append(tag)
            tag = frm[1] if tag else frm[0]
        return tags[::-1]

    def starts(self, text: str | None) -> list[int]:
        """Code point offsets of the first character of every sentence; none for null, empty or blank text."""
        out: list[int] = []
        for a, b, listed in blocks(text or ""):
            out.append(a)
            if listed:
                continue
            para = text[a:b]
            places = [p for p in candidates(para) if p[1] < len(para)]
            for (_, e, _), tag in zip(places, self.tags(para, places), strict=True):
                if tag:
                    nxt = e
                    while nxt < len(para) and para[nxt].isspace():
                        nxt += 1
                    if nxt < len(para):
                        out.append(a + nxt)
        return out


def _script_key(before: str, mark: str) -> str:
    return ("bare" if mark.isspace() else "end") + (script(before[-1]) if before else "x")


def stripped(paragraph: str) -> str:
    """The paragraph without terminators, if most of its letters belong to a script that writes none; else as it is."""
    bare = len(_BARE.findall(paragraph))
    return _WRITTEN.sub("", paragraph) if bare and 2 * bare > sum(map(str.isalpha, paragraph)) else paragraph


def _joined(texts: Iterable[str]) -> Iterator[tuple[str, str, str, bool, bool]]:
    """(before, mark, after, is_joint, in_quotation) of every place of the texts with paragraphs joined."""
    for text in texts:
        paras = [p for a, b, listed in blocks(text or "") if not listed and (p := stripped(text[a:b]).strip())]
        for i, para in enumerate(paras):
            following = paras[i + 1] if i + 1 < len(paras) else ""
            places = candidates(para)
            tail = _BARE.search(para) is not None and not (places and places[-1][1] == len(para))
            at = 0
            for s, e, no in places:
                before, at = para[max(at, s - 24) : s], e
                if e < len(para):
                    yield before, para[s:e], para[e : e + 20].lstrip()[:16], False, no
                elif following:
                    yield before, para[s:e], following[:16], True, no
            if tail and following:  # no terminator is written: the joint is a space
                yield para[-24:], " ", following[:16], True, False


def train(texts: list[str], rounds: int = 200, decay: float = 6.0, least: int = 10, repeats: int = 2) -> Model:
    """The model from raw texts. Same texts, same model. Features seen in fewer than least places are left out: they would only remember places."""
    rows = [r for r in _joined(texts) if not r[4]]
    vocabulary: dict[str, int] = {}
    named = [features(*r[:3]) for r in rows]
    often = Counter(f for x in named for f in x)
    ids = [[vocabulary.setdefault(f, len(vocabulary)) for f in x if often[f] >= least] for x in named]
    n, width = len(rows), max((len(x) for x in ids), default=1)
    decay /= max(n, 1)  # a feature needs about as many places behind it, however large the sample
    size = len(vocabulary)
    grid = np.full((n, width), size, np.int64)
    for i, x in enumerate(ids):
        grid[i, : len(x)] = x
    y = np.array([r[3] for r in rows], float)
    joint = y > 0
    keys = np.array([_script_key(r[0], r[1]) for r in rows], dtype=object)
    w, bias, g = _fit(grid, y, size, rounds, decay)
    c = {"*": float(np.mean(g[joint])) if joint.any() else 0.5}
    for k in set(keys[joint]):
        own = g[joint & (keys == k)]
        c[k] = float((own.sum() + 5 * c["*"]) / (len(own) + 5))
    sure = np.array([c.get(k, c["*"]) for k in keys])
    for _ in range(repeats):  # the labels found so far, learned again: what differs by chance evens out
        w, bias, g = _fit(grid, ((g > FROM * sure) | joint).astype(float), size, rounds // 2, decay)
        sure, c = np.ones(n), {"*": 1.0}
    weights = {f: float(w[i]) for f, i in vocabulary.items() if abs(w[i]) > 1e-3}
    model = Model(weights, float(bias), c, [[0.0, 0.0], [0.0, 0.0]])
    model.moves = _moves(model, texts)
    return model


def _fit(grid: np.ndarray, y: np.ndarray, size: int, rounds: int, decay: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Logistic regression on rows of feature numbers (size: none) by Adam on all rows: weights, bias, fitted values."""
    n, width = grid.shape
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    bias = mb = vb = 0.0
    flat = grid.ravel()
    for t in range(1, rounds + 1 if n else 1):
        d = (1 / (1 + np.exp(-np.clip(w[grid].sum(1) + bias, -30, 30))) - y) / n
        grad = np.bincount(flat, np.repeat(d, width), size + 1) + decay * w
        grad[size] = 0
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        mb, vb = 0.9 * mb + 0.1 * d.sum(), 0.99 * vb + 0.01 * d.sum() ** 2
        bias -= 0.1 * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return w, bias, (1 / (1 + np.exp(-np.clip(w[grid].sum(1) + bias, -30, 30))) if n else np.zeros(0))


def _moves(model: Model, texts: list[str]) -> list[list[float]]:
    counts = np.ones((2, 2))
    for text in texts:
        for a, b, listed in blocks(text or ""):
            if listed:
                continue
            para = text[a:b]
            places = [p for p in candidates(para) if p[1] < len(para)]
            tags = model.tags(para, places)
            for x, z in zip([False, *tags], tags, strict=False):
                counts[int(x), int(z)] += 1
    total = counts.sum()
    # Emissions already carry P(boundary); a move adds how far the pair departs from independence, at half weight.
    p = counts / total
    own = p.sum(0)
    return [[0.5 * math.log(p[i, j] / (p[i].sum() * own[j])) for j in range(2)] for i in range(2)]


def drawn(documents: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, sample_script: int = SAMPLE_SCRIPT) -> list[str]:
    """The texts of the least hashes of their keys: sample of all, and sample_script of each script, in that order; the same in any order of rows.

    Scripts are told of the POOL * sample least hashes, of which a count of the rows gives the share. A script is that of the first letter, or
    one without terminators anywhere in the text.
    """
    h = F.shiftrightunsigned(F.xxhash64(key), 1)
    every = documents.select(h.alias("h"), F.col(text).alias("t")).filter(F.length("t") > 0)
    rows = documents.select(key).count()
    # Hashes are even: a share of them holds about that share of the rows.
    share = lambda n: every if n >= rows else every.filter(F.col("h") < int(n / rows * (1 << 63)))
    some = share(POOL * sample)
    first = F.regexp_extract("t", r"\p{L}", 0)
    bare = [(lo, hi, name) for lo, hi, name in _RANGES if name in "TOMR"]
    kind = F.coalesce(*[F.when(F.col("t").rlike(f"[{chr(lo)}-{chr(hi)}]"), name) for lo, hi, name in bare], *[F.when(first.between(chr(lo), chr(hi)), name) for lo, hi, name in _RANGES], F.lit("x"))
    each = some.withColumn("script", kind).withColumn("rn", F.row_number().over(Window.partitionBy("script").orderBy("h", "t"))).filter(F.col("rn") <= sample_script)
    found = {(r["h"], r["t"]) for r in share(2 * sample).orderBy("h", "t").limit(sample).collect()} | {(r["h"], r["t"]) for r in each.select("h", "t").collect()}
    return [t for _, t in sorted(found)]


def labelled(samples: DataFrame, language: str = "language", text: str = "sample_text", most: int = SAMPLE_LABELLED) -> list[tuple[str, str]]:
    """(language, text) in order: of each language the most texts of the least hashes; a language is at most one of the codes known, else null and left out."""
    rows = samples.select(F.col(language).alias("l"), F.col(text).alias("t")).filter("l IS NOT NULL AND length(trim(t)) > 0").distinct()
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("t"), "t"))).filter(F.col("rn") <= most)
    return sorted((r["l"], r["t"]) for r in ranked.select("l", "t").limit(MOST_LANGUAGES * most).collect())


MOST_LANGUAGES = 1000
_trained: dict[str, Model] = {}


def train_on(documents: DataFrame, samples: DataFrame | None = None, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, sample_script: int = SAMPLE_SCRIPT) -> Model:
    """The model from a bounded sample of documents and labelled samples. The same sample is learned once a process."""
    rows = drawn(documents, text, key, sample, sample_script)
    if samples is not None:
        by: dict[str, list[str]] = {}
        for language, t in labelled(samples):
            by.setdefault(language, []).append(t)
        rows += ["\n\n".join(x) for x in by.values()]
    name = xxhash.xxh3_128_hexdigest("\0".join(rows).encode("utf-8", "replace"))
    if name not in _trained:
        _trained[name] = train(rows)
    return _trained[name]


def sentence_starts(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_start), one row a sentence; a null or blank text has none. No shuffle: each text is cut where it is read."""

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            starts = [model.starts(t) for t in pdf["_text"]]
            yield pd.DataFrame({"_key": np.repeat(pdf["_key"].to_numpy(), [len(s) for s in starts]), "sentence_start": np.array([x for s in starts for x in s], np.int64)})

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_key IS NOT NULL AND length(_text) > 0")).mapInPandas(cut, f"_key {kind}, sentence_start bigint").withColumnRenamed("_key", key)


def sentences(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_ix, sentence_start, sentence) in order; the sentence without the space after it."""

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for k, t in zip(pdf["_key"], pdf["_text"], strict=True):
                s = model.starts(t)
                out += [(k, i, a, t[a:b].rstrip()) for i, (a, b) in enumerate(zip(s, [*s[1:], len(t)], strict=True))]
            yield pd.DataFrame(out, columns=["_key", "sentence_ix", "sentence_start", "sentence"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_key IS NOT NULL AND length(_text) > 0")).mapInPandas(cut, f"_key {kind}, sentence_ix int, sentence_start bigint, sentence string").withColumnRenamed("_key", key)
