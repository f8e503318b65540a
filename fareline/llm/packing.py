"""Filling containers of fixed capacity with texts, by the sum-of-squares rule."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this vocabulary, in its form without backtracking.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of whole texts; null and empty texts have 0 tokens. Narrow, in Arrow batches."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["key", "n_tokens"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)


class SumOfSquares:
    """Open bins counted by residual gap; an item goes where the sum of the squared counts becomes smallest.

    Of equal choices the one with the smallest gap left is taken. A size is a choice only as a bin with room
    or a new bin; a full bin leaves the sum.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = 0

    def place(self, size: int) -> int:
        """The number of the bin that takes the item; size from 1 to the capacity."""
        open_, left = self.count[size:], self.count[: self.capacity + 1 - size]
        # moving a bin from gap g to g - size changes the sum by 2 (count[g - size] - count[g]) + 2, or + 1 to gap 0
        change = np.where(open_ > 0, 2 * (left - open_) + 2, np.iinfo(np.int64).max)
        if open_[0] > 0:
            change[0] = 1 - 2 * open_[0]
        best = int(change.argmin())
        fresh = 2 * int(self.count[self.capacity - size]) + 1 if size < self.capacity else 0
        if fresh < change[best]:
            number, gap = self.opened, self.capacity - size
            self.opened += 1
        else:
            number, gap = self.bins[best + size].pop(), best
            self.count[best + size] -= 1
        if gap:
            self.bins[gap].append(number)
            self.count[gap] += 1
        return number


PLACED = "key {kind}, piece int, token_start bigint, n_tokens bigint, shard int, bin bigint"


def pack(sizes: DataFrame, capacity: int, rows: int, key: str = "doc_id", size: str = "n_tokens", per_shard: int = 100_000) -> DataFrame:
    """(key, piece, token_start, n_tokens, sequence_id): each item's place.

    An item over the capacity is cut into pieces of exactly the capacity, each a sequence of its own, and a
    rest that is packed like any item; others are never split. Items of no size have a null sequence_id,
    as they take no room. No size (null) counts as 0. Repeated keys are items of their own.

    Items (``rows`` of them, which sets only the number of shards) are spread by hash into shards of about ``per_shard``, each with bins of its own: the memory of a
    task is bounded, and the bins still open at a shard's end (some dozens) are few beside those it fills.
    """
    kind = sizes.schema[key].dataType.simpleString()
    shards = max(1, -(-rows // per_shard))
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    items = sizes.select(F.col(key).alias("key"), n.alias("n")).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers: dict[int, SumOfSquares] = {}
        for batch in batches:
            rows: list[tuple] = []
            for k, n, shard in zip(*(c.to_pylist() for c in batch.columns)):
                packer = packers.get(shard) or packers.setdefault(shard, SumOfSquares(capacity))
                if n == 0:
                    rows.append((k, 0, 0, 0, shard, None))
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((k, piece, start, length, shard, packer.place(length)))
            columns = list(zip(*rows)) or [()] * 6
            types = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "piece", "token_start", "n_tokens", "shard", "bin"])

    # a shard is a task: hashes of shard numbers would put several into one and none into others
    placed = items.repartitionById(shards, "shard").sortWithinPartitions("shard", "key", "n").mapInArrow(run, PLACED.format(kind=kind))
    return placed.select(F.col("key").alias(key), "piece", "token_start", "n_tokens", F.when(F.col("bin").isNotNull(), F.concat_ws("-", "shard", "bin")).alias("sequence_id"))
