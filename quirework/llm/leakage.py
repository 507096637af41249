"""Evaluation passages in training texts: prefix-filtered join with exact containment over item-sized windows.

Every window of `window` words of an item is covered by shingles of `shingle` words. Shingles are ordered by rarity in
the corpus (counted over all documents); a document that holds a window holds all its shingles, so its rarest
one is a necessary prefix. Documents are probed with the necessary shingles only; the position of a hit fixes where the
item must lie (positional bound), an item shorter than the window is never looked for (length bound), and the run of
equal words around the hit is measured exactly. Up to ITEMS_A_BLOCK items travel with the function; more, however many,
are joined to the documents by shuffles on their necessary shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import materialize, spread

WINDOW, SHINGLE = 12, 4
ITEMS_A_BLOCK = 5_000
#: Bits of the filter of item shingles: BITS_A_KEY each, within these bounds. Beyond them it only lets more through to the exact join.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 16, 1 << 27, 16
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _keys(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit key of the k ids at each position (shorter texts have none)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    u = ids.astype(np.uint64) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ u[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


class Index:
    """The items of one block: vocabulary, words as numbers, shingles; after rank(), the necessary shingles."""

    def __init__(self, items: list[tuple[int, str]], window: int, shingle: int):
        self.window, self.shingle = window, shingle
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        for item, text in items:
            found = words(text)
            if len(found) >= window:
                self.items.append(item)
                self.ids.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found], np.int64))
        self.shingles = np.unique(np.concatenate([_keys(x, shingle) for x in self.ids])) if self.ids else np.zeros(0, np.uint64)
        self.rare: dict[int, list[tuple[int, int]]] = {}
        self.rare_keys = np.zeros(0, np.uint64)

    def numbers(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words(text)], np.int64)

    def probe(self, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Positions of ids whose shingle is in the sorted keys."""
        k = self.shingle
        if len(ids) < k or not len(keys):
            return np.zeros(0, np.int64)
        known = ids >= 0
        run = np.lib.stride_tricks.sliding_window_view(known, k).all(1)
        at = np.flatnonzero(run)
        if not len(at):
            return at
        h = _keys(ids, k)[at]
        where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at[keys[where] == h]

    def rank(self, counts: dict[int, int]) -> None:
        """Of each window of each item, its rarest shingle by counts (ties by key)."""
        span = self.window - self.shingle + 1
        chosen: dict[int, set[tuple[int, int]]] = {}
        for number, ids in enumerate(self.ids):
            keys = _keys(ids, self.shingle)
            order = [(counts.get(int(k), 0), int(k)) for k in keys]
            for start in range(len(ids) - self.window + 1):
                at = min(range(start, start + span), key=order.__getitem__)
                chosen.setdefault(int(keys[at]), set()).add((number, at))
        self.rare = {k: sorted(v) for k, v in chosen.items()}
        self.rare_keys = np.array(sorted(self.rare), np.uint64)

    def leaks(self, text: str) -> set[int]:
        """Items of which the text holds window words or more in a row."""
        ids = self.numbers(text)
        at = self.probe(ids, self.rare_keys)
        if not len(at):
            return set()
        keys = _keys(ids, self.shingle)
        out: set[int] = set()
        for p in at:
            for number, q in self.rare[int(keys[p])]:
                if self.items[number] in out:
                    continue
                item = self.ids[number]
                a, b, n = int(p), q, self.window
                lo, hi = max(-(n - self.shingle), -min(a, b)), min(n, len(ids) - a, len(item) - b)
                same = ids[a + lo : a + hi] == item[b + lo : b + hi]
                run = best = 0
                for x in same:
                    run = run + 1 if x else 0
                    best = max(best, run)
                if best >= n:
                    out.add(self.items[number])
        return out


def leaked_items(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text", items_a_block: int = ITEMS_A_BLOCK) -> DataFrame:
    """(key, item_id), distinct: documents that hold window or more consecutive words of an item.

    Null keys, ids and texts match nothing; items of fewer than window words are never found. Of an item_id with several texts each counts.
    """
    usable = items.select("item_id", "item_text").filter("item_id IS NOT NULL AND item_text IS NOT NULL").distinct()
    texts = spread(documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_key IS NOT NULL AND length(_text) > 0"))
    first = usable.take(items_a_block + 1)
    found = _few(texts, sorted(tuple(r) for r in first), usable, window, shingle) if len(first) <= items_a_block else _many(texts, usable, window, shingle)
    return found.distinct().withColumnRenamed("_key", key)


def _few(texts: DataFrame, rows: list[tuple], items: DataFrame, window: int, shingle: int) -> DataFrame:
    """At most a block of items: the index goes with the function, the corpus is read once to count and once to find."""
    schema = f"_key {texts.schema['_key'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"
    index = Index(rows, window, shingle)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(len(index.shingles), np.int64)
        for pdf in it:
            for t in pdf["_text"]:
                ids = index.numbers(t)
                at = index.probe(ids, index.shingles)
                if len(at):
                    found += np.bincount(np.searchsorted(index.shingles, np.unique(_keys(ids, shingle)[at])), minlength=len(found))
        some = np.flatnonzero(found)
        yield pd.DataFrame({"k": some, "n": found[some]})

    if index.items:
        # One row a shingle of the block: at most ITEMS_A_BLOCK items' words.
        index.rank({int(index.shingles[r[0]]): r[1] for r in texts.select("_text").mapInPandas(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator()})

    def find(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [(k, i) for k, t in zip(pdf["_key"], pdf["_text"], strict=True) for i in index.leaks(t)]
            yield pd.DataFrame(found, columns=["_key", "item_id"])

    return texts.mapInPandas(find, schema)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) >> 1
        return h


def _shingled(known: _Hashes, text: str, shingle: int) -> np.ndarray:
    """The key of the shingle at each word of a text, as signed numbers."""
    return _keys(np.array([known[w] for w in words(text)], np.int64), shingle).view(np.int64)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the keys (k BIGINT) modulo the size, packed; of bounded size."""
    bits, n = LEAST_BITS, keys.count()
    while bits < min(MOST_BITS, BITS_A_KEY * n):
        bits *= 2
    out = np.zeros(bits // 8, np.uint8)
    at = keys.select(F.pmod("k", F.lit(bits)).alias("p"))
    for r in at.groupBy(F.floor(F.col("p") / 32768).alias("b")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("m")).toLocalIterator():
        part = np.frombuffer(bytes(r["m"]), np.uint8)
        out[int(r["b"]) * 4096 : int(r["b"]) * 4096 + 4096] = part[: len(out)]
    return out


def _many(texts: DataFrame, items: DataFrame, window: int, shingle: int) -> DataFrame:
    """Any number of items: shingles of items and documents meet in one shuffled join; one pass over the documents serves counting and joining.

    Documents send only positions whose shingle passes the filter of all item shingles. Pairs that meet in a necessary shingle are checked on their words.
    """
    kind, item_kind = texts.schema["_key"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    span = window - shingle + 1
    texted = items.select("item_id", F.xxhash64("item_text").alias("ver"), "item_text")

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for pdf in it:
            parts = []
            for i, v, t in zip(pdf["item_id"], pdf["ver"], pdf["item_text"], strict=True):
                k = _shingled(known, t, shingle)
                if len(k) >= span:
                    parts.append(pd.DataFrame({"item_id": i, "ver": v, "at": np.arange(len(k)), "k": k}))
            if parts:
                yield pd.concat(parts)

    of_items = materialize(texted.mapInPandas(cut, f"item_id {item_kind}, ver bigint, at int, k bigint"), "itemshingles")
    bits = _bitmap(of_items.select("k").distinct())

    def probe(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, size = _Hashes(), 8 * len(bits)
        for pdf in it:
            parts = []
            for key, t in zip(pdf["_key"], pdf["_text"], strict=True):
                k = np.unique(_shingled(known, t, shingle))
                p = np.mod(k, size)
                hit = k[(bits[p >> 3] >> (p & 7)) & 1 == 1]
                if len(hit):
                    parts.append(pd.DataFrame({"_key": key, "k": hit}))
            if parts:
                yield pd.concat(parts)

    hits = materialize(texts.mapInPandas(probe, f"_key {kind}, k bigint"), "itemhits")
    counts = hits.groupBy("k").agg(F.count("*").alias("n"))

    def choose(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows: set[tuple] = set()
            for i, v, at, ks, ns in zip(pdf["item_id"], pdf["ver"], pdf["at"], pdf["k"], pdf["n"], strict=True):
                order = np.lexsort((ks, ns))
                rank = np.empty(len(order), np.int64)
                rank[np.asarray(at)[order]] = np.arange(len(order))
                by_place = np.asarray(ks)[np.argsort(at)]
                low = np.lib.stride_tricks.sliding_window_view(rank, span).argmin(1) + np.arange(len(rank) - span + 1)
                rows |= {(i, v, int(by_place[p])) for p in low}
            yield pd.DataFrame(sorted(rows, key=str), columns=["item_id", "ver", "k"])

    each = of_items.join(counts, "k", "left").groupBy("item_id", "ver").agg(F.sort_array(F.collect_list(F.struct("at", "k", F.coalesce("n", F.lit(0)).alias("n")))).alias("x"))
    rare = each.select("item_id", "ver", F.col("x.at").alias("at"), F.col("x.k").alias("k"), F.col("x.n").alias("n")).mapInPandas(choose, f"item_id {item_kind}, ver bigint, k bigint")
    pairs = hits.join(rare, "k").select("_key", "item_id", "ver").distinct().join(texted, ["item_id", "ver"]).join(texts, "_key")

    def check(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indices: dict = {}
        for pdf in it:
            rows = []
            for key, i, v, item, t in zip(pdf["_key"], pdf["item_id"], pdf["ver"], pdf["item_text"], pdf["_text"], strict=True):
                if len(indices) > 10_000:
                    indices.clear()
                if (i, v) not in indices:
                    indices[i, v] = Index([(i, item)], window, shingle)
                    indices[i, v].rank({})
                if indices[i, v].leaks(t):
                    rows.append((key, i))
            yield pd.DataFrame(rows, columns=["_key", "item_id"])

    return pairs.select("_key", "item_id", "ver", "item_text", "_text").mapInPandas(check, f"_key {kind}, item_id {item_kind}")
