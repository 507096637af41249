"""Near-duplicate texts: BK-trees over Hamming distance, in shards of rare shingles, verified exactly.

Texts with the same set of shingles form one class at once; only one representative of each goes on. A fingerprint has one
bit for each of PLANES groups of shingles, set where an odd number of the text's shingles falls into the group. A shingle that only one of two texts has
changes one bit at most, so the Hamming distance is never more than the number of such shingles, and texts of n and m
shingles and similarity t lie within (n + m)(1 - t)/(1 + t) of each other without exception. One tree of all texts could
not be broadcast, so trees are built per shard: in any order of all shingles, two texts of similarity t share k of the first
n - ceil(t n) + k of each (prefix filter), so every prefix shingle is a shard. The order is by rarity, read from a sketch of counts over all texts: of
fixed size, and as good as exact counts for the result, since any order is right. k is COMMON, less where the shingles that would
make it so are hot, and never more than the pair must share in all. In a shard a BK-tree, one for each class of sizes, keeps children
by their integer Hamming distance to the parent and a query follows only the edges within the radius of the two sizes.
Pairs found in k shards are verified on the shingles themselves. Shards of more than BLOCK texts are hot: they are cut into blocks,
a tree each, and every text of the shard queries all of them, so no group is collected whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import broadcast_if_small, materialize, spread

WIDTH, SIMILARITY, LEAST_WORDS = 3, 0.5, 30
PLANES, BLOCK, COMMON = 192, 2000, 3
#: Sizes within this factor share a tree.
SIZE_STEP = 1.15
#: Buckets of the sketch and pieces it travels in.
SKETCH, PIECES = 1 << 22, 64
HASH_BITS = 48
_WORD = re.compile(r"[^\W_]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def radius(n: int, m: int, similarity: float) -> int:
    """The most shingles that only one of two texts of n and m shingles has, at this similarity or more."""
    return math.floor((n + m) * (1 - similarity) / (1 + similarity) + 1e-9)


def least_common(n: int, m: int, similarity: float) -> int:
    """The fewest shingles two texts of n and m shingles share at this similarity."""
    return max(1, math.ceil((n + m) * similarity / (1 + similarity) - 1e-9))


class Shingler:
    """Distinct shingles of texts as sorted 64-bit hashes. Hashes of words are remembered."""

    def __init__(self, width: int = WIDTH, least_words: int = LEAST_WORDS):
        self.width, self.least = width, max(least_words, width)
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray | None:
        """None for a text of fewer than least words."""
        found = _WORD.findall((text or "").lower())
        if len(found) < self.least:
            return None
        known = self.known
        if len(known) > 500_000:
            known.clear()
        ids = []
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            ids.append(h)
        u = np.array(ids, np.uint64)
        out = np.zeros(len(u) - self.width + 1, np.uint64)
        for j in range(self.width):
            out = (out ^ u[j : j + len(out)]) * _P
            out ^= out >> np.uint64(29)
        return np.unique(out)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each set, a row of PLANES / 64 words: bit k tells whether an odd number of shingles falls into group k."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets) * _P
    group = ((h >> np.uint64(32)) % np.uint64(PLANES)).astype(np.int64)
    odd = (np.bincount(owner * PLANES + group, minlength=len(sets) * PLANES) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sets), PLANES), axis=1).view(np.uint64)


class BKTree:
    """Nodes hold a fingerprint and the items that have it; children are keyed by their distance to the parent."""

    __slots__ = ("root",)

    def __init__(self):
        self.root: list | None = None  # [fingerprint, items, children]

    def add(self, fingerprint: int, item: tuple) -> None:
        if self.root is None:
            self.root = [fingerprint, [item], {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ fingerprint).bit_count()
            if d == 0:
                node[1].append(item)
                return
            child = node[2].get(d)
            if child is None:
                node[2][d] = [fingerprint, [item], {}]
                return
            node = child

    def within(self, fingerprint: int, r: int) -> Iterator[tuple]:
        """Items at a distance of at most r: only edges between d - r and d + r can lead to them."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            d = (node[0] ^ fingerprint).bit_count()
            if d <= r:
                yield from node[1]
            if node[2]:
                stack += [c for e, c in node[2].items() if d - r <= e <= d + r]


def classes(texts: DataFrame, key: str = "ldu_id", text: str = "content", width: int = WIDTH, least_words: int = LEAST_WORDS) -> tuple[DataFrame, np.ndarray]:
    """(id, c1, c2, n): the class of each text by its set of n shingles, and the sketch of how often shingles occur.

    Texts of fewer than least_words words and null keys have no class. One pass gives both.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = Shingler(width, least_words)
        count = np.zeros(SKETCH, np.uint32)
        for pdf in it:
            out = []
            sets = []
            for k, t in zip(pdf["id"], pdf["t"], strict=True):
                s = cut(t)
                if s is not None:
                    h = xxhash.xxh3_128_intdigest(s.tobytes())
                    out.append((k, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), len(s), -1, None))
                    sets.append(s)
            if sets:
                at, n = np.unique(np.concatenate(sets) & np.uint64(SKETCH - 1), return_counts=True)
                count[at] += n.astype(np.uint32)
            yield pd.DataFrame(out, columns=["id", "c1", "c2", "n", "piece", "counts"])
        size = SKETCH // PIECES
        rows = [(0, 0, 0, 0, i, zlib.compress(part.tobytes(), 1)) for i in range(PIECES) if (part := count[i * size : (i + 1) * size]).any()]
        yield pd.DataFrame(rows, columns=["id", "c1", "c2", "n", "piece", "counts"])

    kind = texts.schema[key].dataType.simpleString()
    # A word and the mark after it take two characters at least.
    both = spread(texts.select(F.col(key).alias("id"), F.col(text).alias("t")).filter("id IS NOT NULL").filter(F.length("t") >= 2 * least_words - 1)).mapInPandas(run, f"id {kind}, c1 bigint, c2 bigint, n int, piece int, counts binary")
    both = materialize(both, "classes")
    return both.filter("piece = -1").select("id", "c1", "c2", "n").distinct(), _sketch(both.filter("piece >= 0").select("piece", "counts"))


def _sketch(pieces: DataFrame) -> np.ndarray:
    """Counts by bucket, summed piece by piece as the rows come by; PIECES rows reach the driver, SKETCH numbers in all."""

    def add(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in it:
            for i, c in zip(pdf["piece"], pdf["counts"], strict=True):
                part = np.frombuffer(zlib.decompress(c), np.uint32)
                total[i] = total[i] + part if i in total else part.astype(np.uint64)
        # Six bits of mantissa are enough for an order; one still means one.
        yield pd.DataFrame({"piece": list(total), "counts": [zlib.compress(np.where(v < 64, v, 64 + 8 * np.log2(np.maximum(v, 64) / 64)).clip(0, 255).astype(np.uint8).tobytes(), 1) for v in total.values()]})

    out = np.zeros(SKETCH, np.uint8)
    size = SKETCH // PIECES
    for r in pieces.repartition("piece").mapInPandas(add, "piece int, counts binary").toLocalIterator():
        out[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return out


def representatives(members: DataFrame, texts: DataFrame, key: str = "ldu_id", text: str = "content") -> DataFrame:
    """(rep, t): the least key of every class with its text."""
    reps = members.groupBy("c1", "c2").agg(F.min("id").alias("rep")).select("rep")
    return texts.select(F.col(key).alias("rep"), F.col(text).alias("t")).join(reps, "rep", "left_semi").groupBy("rep").agg(F.max("t").alias("t"))


class Trees:
    """The trees of one shard and block, one for each class of sizes. Items are (key, shingles, k)."""

    def __init__(self, similarity: float):
        self.t, self.trees = similarity, {}

    def _class(self, n: float) -> int:
        return int(math.log(n) / math.log(SIZE_STEP))

    def add(self, fingerprint: int, item: tuple) -> None:
        c = self._class(item[1])
        tree = self.trees.get(c)
        if tree is None:
            tree = self.trees[c] = [BKTree(), item[1]]
        tree[0].add(fingerprint, item)
        tree[1] = max(tree[1], item[1])

    def near(self, fingerprint: int, n: int) -> Iterator[tuple]:
        """Items of sizes within the similarity whose fingerprint lies within the radius of the class."""
        if len(self.trees) == 1:
            hit = self.trees.values()
        else:
            lo, hi = self._class(self.t * n) - 1, self._class(n / self.t) + 1
            hit = [x for c, x in self.trees.items() if lo <= c <= hi]
        for tree, most in hit:
            for item in tree.within(fingerprint, radius(n, most, self.t)):
                if min(n, item[1]) >= self.t * max(n, item[1]) - 1e-9:
                    yield item


def _deal(similarity: float, width: int, least_words: int, block: int, common: int, sketch: np.ndarray):
    words = [f"f{i}" for i in range(PLANES // 64)]

    def deal(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = Shingler(width, least_words)
        for pdf in it:
            keys, sets = [], []
            for k, t in zip(pdf["rep"], pdf["t"], strict=True):
                s = cut(t)
                if s is not None:
                    keys.append(k)
                    sets.append(s)
            if not sets:
                continue
            prints = fingerprints(sets).view(np.int64)
            taken, sizes, ks = [], [], []
            for s in sets:
                n = len(s)
                c = sketch[s & np.uint64(SKETCH - 1)]
                # Ties of the count are broken by the hash, the same for all texts; what occurs once meets nothing.
                order = np.lexsort((s, c))[: n - math.ceil(similarity * n - 1e-9) + common]
                core = n - math.ceil(similarity * n - 1e-9) + 1
                more = order[core:][times(c[order[core:]]) <= block]  # hot shingles only where one meeting needs them
                ks.append(common if core + len(more) == n else 1 + len(more))
                order = np.r_[order[:core], more]
                order = order[c[order] > 1]
                taken.append(s[order])
                sizes.append(len(order))
            h = np.concatenate(taken)
            row = np.repeat(np.arange(len(sets)), sizes)
            blocks = np.maximum(np.ceil(times(sketch[h & np.uint64(SKETCH - 1)]) / block), 1).astype(np.int64)
            mix = np.array([xxhash.xxh3_64_intdigest(str(k)) >> 1 for k in keys], np.int64)[row]
            own = mix % blocks
            again = np.repeat(np.arange(len(h)), own + 1)
            at = np.arange(len(again)) - np.repeat(np.r_[0, np.cumsum(own + 1)[:-1]], own + 1)
            who = row[again]
            n = np.array([len(s) for s in sets], np.int32) * 4 + np.array(ks, np.int32)
            yield pd.DataFrame({"h": (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)[again], "place": (at * 2 + (at < own[again])).astype(np.int32), "rep": np.array(keys)[who], "n": n[who], **{w: prints[who, i] for i, w in enumerate(words)}})

    return deal


def times(count: np.ndarray) -> np.ndarray:
    """What a count of the sketch stands for."""
    c = count.astype(np.int64)
    return np.where(c < 64, c, 64 * 2 ** ((c - 63) / 8.0))


def candidate_pairs(reps: DataFrame, sketch: np.ndarray, similarity: float = SIMILARITY, width: int = WIDTH, least_words: int = LEAST_WORDS, block: int = BLOCK, common: int = COMMON) -> DataFrame:
    """(a, b), a < b: representatives that meet in as many shards as such a pair must (at most common), by BK-tree within the radius and by length."""
    kind = reps.schema["rep"].dataType.simpleString()
    words = [f"f{i}" for i in range(PLANES // 64)]

    def trees(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, tree, alone = None, None, None
        for pdf in it:
            a: list = []
            b: list = []
            need: list = []
            shard = pdf["h"].to_numpy() * 1024 + (pdf["place"].to_numpy() >> 1) % 1024
            same = np.r_[False, shard[1:] == shard[:-1]]
            # Rows alone in their shard have nothing to meet; the first and last may go on in another batch.
            busy = same | np.r_[same[1:], True]
            busy[0] = True
            part = pdf[busy]
            raw, step = np.ascontiguousarray(part[words].to_numpy()).tobytes(), PLANES // 8
            prints = [int.from_bytes(raw[i : i + step], "little") for i in range(0, len(raw), step)]
            for h, place, rep, nk, fp in zip(part["h"].tolist(), part["place"].tolist(), part["rep"].tolist(), part["n"].tolist(), prints, strict=True):
                n, k = nk >> 2, nk & 3
                node = not place & 1
                if group != (h, place >> 1):
                    group, tree, alone = (h, place >> 1), None, (fp, (rep, n, k))
                    if not node:
                        tree, alone = Trees(similarity), None
                    continue
                if tree is None:
                    tree = Trees(similarity)
                    tree.add(*alone)
                for other, m, j in tree.near(fp, n):
                    if other != rep:
                        a.append(min(rep, other))
                        b.append(max(rep, other))
                        need.append(min(k, j, least_common(n, m, similarity)))
                if node:
                    tree.add(fp, (rep, n, k))
            yield pd.DataFrame({"a": a, "b": b, "need": need}).astype({"a": pdf["rep"].dtype, "b": pdf["rep"].dtype, "need": "int32"})

    dealt = spread(reps).mapInPandas(_deal(similarity, width, least_words, block, common, sketch), f"h bigint, place int, rep {kind}, n int, {', '.join(w + ' bigint' for w in words)}")
    # Within a shard and block the nodes (even places) come first, then the texts of later blocks that query the tree.
    met = dealt.repartition(F.col("h"), F.floor(F.col("place") / 2)).sortWithinPartitions("h", "place", "rep").mapInPandas(trees, f"a {kind}, b {kind}, need int")
    return met.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("need").alias("need")).filter(F.col("c") >= F.col("need")).select("a", "b")


def verified_pairs(pairs: DataFrame, reps: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, least_words: int = LEAST_WORDS) -> DataFrame:
    """(a, b, similarity): pairs whose shingles are similar enough, counted exactly."""
    kind = reps.schema["rep"].dataType.simpleString()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    reps = materialize(reps.join(broadcast_if_small(ids, 200_000), "rep", "left_semi"), "paired")
    with_text = pairs.join(reps.select(F.col("rep").alias("a"), F.col("t").alias("ta")), "a").join(reps.select(F.col("rep").alias("b"), F.col("t").alias("tb")), "b")

    def verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = Shingler(width, least_words)
        for pdf in it:
            known: dict = {}
            rows = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"], strict=True):
                x, y = (known[k] if k in known else known.setdefault(k, cut(t)) for k, t in ((a, ta), (b, tb)))
                both = len(np.intersect1d(x, y, assume_unique=True))
                s = both / (len(x) + len(y) - both)
                if s >= similarity:
                    rows.append((a, b, s))
            yield pd.DataFrame(rows, columns=["a", "b", "similarity"])

    return with_text.mapInPandas(verify, f"a {kind}, b {kind}, similarity double")


def near_duplicates(texts: DataFrame, key: str = "ldu_id", text: str = "content", similarity: float = SIMILARITY, width: int = WIDTH, least_words: int = LEAST_WORDS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """members (id, rep, n) and links (a, b, similarity) between representatives. Null and short texts are in neither."""
    found, sketch = classes(texts, key, text, width, least_words)
    members = found.join(found.groupBy("c1", "c2").agg(F.min("id").alias("rep")), ["c1", "c2"]).select("id", "rep", "n")
    reps = materialize(representatives(found, texts, key, text), "reps")
    pairs = materialize(candidate_pairs(reps, sketch, similarity, width, least_words, block), "pairs")
    return materialize(members, "members"), materialize(verified_pairs(pairs, reps, similarity, width, least_words), "links")


def all_pairs(members: DataFrame, links: DataFrame, share: int = 1000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: links and classes written out member by member; a class of many copies is dealt to parts of about share."""
    sizes = members.groupBy("rep").agg(F.count("*").alias("size")).filter("size > 1")
    m = members.select("id", "rep").join(sizes.select("rep", F.ceil(F.col("size") / share).cast("int").alias("parts")), "rep")
    one = m.select("rep", F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    every = m.select("rep", F.col("id").alias("j"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    same = one.join(every, ["rep", "part"]).filter("i < j").select(F.col("i").alias("id_a"), F.col("j").alias("id_b"))
    m = members.select("id", "rep")
    left = links.select("a", "b").join(m.select(F.col("id").alias("i"), F.col("rep").alias("a")), "a").join(m.select(F.col("id").alias("j"), F.col("rep").alias("b")), "b")
    return same.unionByName(left.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, links, group_id): the least key of its class and of its connected group, and to how many other texts it is linked.

    Components by label propagation with a jump to the label's own label every round; each round is written to the shared folder.
    """
    sizes = members.groupBy("rep").agg(F.count("*").alias("size"))
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "label")
    while True:
        near = edges.join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        low = label.join(near, "a").select("a", F.least("label", "m").alias("low"), "label")
        jump = low.join(label.select(F.col("a").alias("low"), F.col("label").alias("far")), "low", "left").select("a", F.least(F.col("low"), F.coalesce("far", "low")).alias("label"), (F.least(F.col("low"), F.coalesce("far", "low")) < F.col("label")).alias("moved"))
        after = materialize(jump, "label")
        label = after.select("a", "label")
        if after.filter("moved").isEmpty():
            break
    linked = edges.join(sizes.select(F.col("rep").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("others"))
    info = sizes.join(linked.withColumnRenamed("a", "rep"), "rep", "left").join(label.withColumnRenamed("a", "rep"), "rep", "left")
    return members.join(info, "rep").select("id", F.col("rep").alias("class_id"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("label", "rep").alias("group_id"))
