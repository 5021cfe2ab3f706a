"""Helpers shared by the training-data operators."""

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchlake.session import new_work_folder

# The bytes that end a word; equal to what bytes.split() separates on.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

# Lower-cases A-Z and leaves every other byte alone.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(rows: DataFrame, purpose: str) -> DataFrame:
    """``rows``, written to the shared folder and read back: computed once, lineage cut."""
    path = new_work_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def without_cycle_search() -> Iterator[None]:
    """Python's search for unreachable cycles waits until the end of the block.

    It walks all lists and tables again and again while a block of texts is cut into many small
    strings, which hold no cycles. What is not referred to any more goes at once all the same.
    """
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, or a longer name that no column of ``taken`` has, in any case of letters."""
    lower = {name.lower() for name in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; -1 where the key is null."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds, F.lit(-1))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes, A-Z lower-cased; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()


def mix64(values: np.ndarray, seed: int) -> np.ndarray:
    """A well-mixed 64-bit value for each one of ``values``, another for each seed."""
    x = values.astype(np.uint64, copy=True)
    x += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """Connected components as (node, label), label being the smallest node reached.

    ``edges`` has long columns ``a`` and ``b``. Nodes without an edge are absent.
    Large-star and small-star rounds alternate until no edge changes; each round is
    written to the shared folder. A node's neighbours are never gathered: a round
    takes the smallest by an aggregate and joins it back.
    """
    pairs = saved(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        purpose,
    )
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            both.where("b > a").join(low, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        ).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("low").alias("b")).unionByName(
            joined.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        pairs = saved(small.distinct(), purpose)
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
