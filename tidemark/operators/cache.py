"""Replay of block accesses through sharded LRU caches."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bloom
from tidemark.ship import ship


def with_shard(trace: DataFrame, shards: int = 16) -> DataFrame:
    """`trace` (pos, file_num, offset) with shard."""
    ship(trace.sparkSession)

    @F.pandas_udf("long")
    def shard(files: pd.Series, offsets: pd.Series) -> pd.Series:
        return pd.Series(bloom.shard_of(files.to_numpy(), offsets.to_numpy(), shards))

    return trace.withColumn("shard", shard("file_num", "offset"))


def replay(trace: DataFrame, capacity: int) -> DataFrame:
    """(shard, pos, hit, evicted): each access of `trace` (shard, pos, file_num, offset) in order of pos, one LRU of `capacity` a shard.

    The state is ordered, so a shard is one stream: partitions are sorted by (shard, pos) and read batch by batch, never a whole
    shard at once. Shards, of which a cache has a fixed number, bound the parallelism.
    """
    ship(trace.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caches: dict[int, OrderedDict] = {}
        for f in frames:
            hits, gone = [], []
            for shard, file_num, offset in zip(f["shard"], f["file_num"], f["offset"], strict=True):
                lru = caches.setdefault(shard, OrderedDict())
                block = (file_num, offset)
                hits.append(block in lru)
                lru[block] = None
                lru.move_to_end(block)
                gone.append(len(lru) > capacity)
                if gone[-1]:
                    lru.popitem(last=False)
            yield pd.DataFrame({"shard": f["shard"], "pos": f["pos"], "hit": hits, "evicted": gone})

    return trace.repartition("shard").sortWithinPartitions("shard", "pos").mapInPandas(run, "shard long, pos long, hit boolean, evicted boolean")


def hit_ratio(replayed: DataFrame, by: list[str] | None = None) -> DataFrame:
    return replayed.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("accesses"), F.count_if(F.col("hit")).alias("hits"), F.count_if(F.col("evicted")).alias("evictions"), F.coalesce(F.count_if(F.col("hit")) / F.count(F.lit(1)), F.lit(0.0)).alias("hit_ratio")
    )
