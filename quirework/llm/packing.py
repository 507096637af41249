"""Texts packed into containers of a fixed number of tokens: sum-of-squares packing.

Each text goes where the sum of squares of the numbers of open containers per remaining gap becomes smallest
(an open container whose gap is large enough, or a new one). The algorithm is sequential, so texts are dealt by hash
into shards of about SHARD_ROWS; containers left with too much space are emptied once and their texts packed again, in
fewer shards. A text longer than a container is cut into full containers and a rest.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import materialize, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SHARD_ROWS, REPACK_BELOW = 20_000, 0.97
# Fixed value: the pattern that splits text before the merges of a byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, once a process."""
    if path not in _encoders:
        if importlib.util.find_spec("tiktoken") is None:
            raise RuntimeError("packing by tokens needs tiktoken")
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())}
        _encoders[path] = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens); null and empty texts have 0 tokens. Rows with a null key are left out. The vocabulary is read where the driver is and travels to the executors."""
    name = Path(vocabulary).name
    if not Path(SparkFiles.getRootDirectory(), name).exists():
        documents.sparkSession.sparkContext.addFile(vocabulary)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(SparkFiles.get(name))
        for pdf in it:
            yield pd.DataFrame({"_key": pdf["_key"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["_text"]]})

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_key IS NOT NULL")).mapInPandas(count, f"_key {kind}, tokens bigint").withColumnRenamed("_key", key)


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item, numbered from 0 as opened; sizes from 0 to capacity, in this order."""
    number = np.zeros(capacity + 1, np.int64)  # open containers by gap; gap 0 is closed
    held: dict[int, list[int]] = {}
    out, opened = [], 0
    for s in sizes:
        if s == 0:
            out.append(max(opened - 1, 0))
            opened = max(opened, 1)
            continue
        # Moving one container from gap g to g - s changes the sum by 2 (N[g-s] - N[g]) + 2; a new one by 2 N[capacity-s] + 1.
        after = number[: capacity + 1 - s].copy()
        after[0] = 0
        before = number[s:]
        change = np.where(before > 0, 2 * (after - before) + 2, np.iinfo(np.int64).max)
        change[0] = -2 * before[0] + 1 if before[0] > 0 else change[0]
        g = int(change.argmin())
        new = 2 * number[capacity - s] + 1 if s < capacity else 0
        if before[g] > 0 and change[g] <= new:
            gap = g + s
            c = held[gap].pop()
            number[gap] -= 1
            rest = g
        else:
            c, rest = opened, capacity - s
            opened += 1
        if rest:
            number[rest] += 1
            held.setdefault(rest, []).append(c)
        out.append(c)
    return out


def _packed(items: DataFrame, shards: int, capacity: int, wave: int) -> DataFrame:
    """items (key, part, tokens) with container, a string of wave, shard and number."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_mix", "_key", "part"])
        pdf["container"] = [f"{wave}-{s}-{c}" for s, c in zip(pdf["_shard"], pack(pdf["tokens"].tolist(), capacity), strict=True)]
        return pdf[["_key", "part", "tokens", "container"]]

    kind = items.schema["_key"].dataType.simpleString()
    dealt = items.withColumn("_mix", F.xxhash64("_key", "part")).withColumn("_shard", F.pmod(F.col("_mix"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(one, f"_key {kind}, part int, tokens bigint, container string")


def pack_documents(documents: DataFrame, capacity: int, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, part, tokens, container): every document, in one container unless it alone exceeds the capacity.

    part counts from 0; the parts of an oversized document are capacity tokens each and the rest. Texts of 0 tokens
    share whatever container is open. A key that comes several times is packed once (its first text by value).
    """
    counted = token_counts(documents, vocabulary, key, text).withColumnRenamed(key, "_key").groupBy("_key").agg(F.max("tokens").alias("tokens"))
    parts = F.greatest(F.ceil(F.col("tokens") / capacity).cast("int"), F.lit(1))
    items = counted.select("_key", "tokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select("_key", "part", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("part") * capacity).alias("tokens"))
    items = materialize(items, "sizes")
    rows = items.count()
    first = materialize(_packed(items, max(1, -(-rows // shard_rows)), capacity, 0), "packed")
    fill = first.groupBy("container").agg(F.sum("tokens").alias("fill"))
    loose = first.join(fill.filter(F.col("fill") < REPACK_BELOW * capacity), "container", "left_semi").select("_key", "part", "tokens")
    kept = first.join(fill.filter(F.col("fill") >= REPACK_BELOW * capacity), "container", "left_semi").select("_key", "part", "tokens", "container")
    left = loose.count()
    again = _packed(loose, max(1, -(-left // shard_rows)), capacity, 1)
    return kept.unionByName(again).withColumnRenamed("_key", key)
