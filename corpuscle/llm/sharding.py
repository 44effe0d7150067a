"""Shards of nearly equal bytes: a minimax contiguous partition of ordered atomic groups. DataFrame operations only."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, take

#: Ordered atoms that texts are hashed to. Their sizes go to the driver and their table back: a fixed number of rows.
ATOMS = 1 << 16
#: Rows that are numbered together.
CELL = 400


def greedy(before: list[int], shards: int, capacity: int) -> list[int] | None:
    """First atom of each shard when each takes atoms in order while it has room; None if atoms are left over.

    ``before``: bytes before each atom, then all bytes.
    """
    cuts, at, n = [], 0, len(before) - 1
    for _ in range(shards):
        cuts.append(at)
        at = bisect_right(before, before[at] + capacity) - 1 if at < n else n
    return cuts if at >= n else None


def minimax(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Smallest capacity for which ``shards`` contiguous runs hold all atoms, and the first atom of each run.

    Binary search between the largest atom or the mean of the shards, whichever is more, and their sum.
    """
    before = [0, *accumulate(sizes)]
    low = max([0, *sizes, -(-before[-1] // shards)])
    high = low + max([0, *sizes])
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(before, shards, mid) is not None else (mid + 1, high)
    return low, greedy(before, shards, low)


def shard_rows(spark: SparkSession, docs: DataFrame, shards: int = 24, atoms: int = ATOMS, cell: int = CELL) -> DataFrame:
    """Puts documents (doc_id, text) into ``shards`` shards of nearly equal bytes; equal texts stay together.

    Law ``bytes``. The atomic groups are all texts with one hash; groups are ordered by it and those in one of
    ``atoms`` equal ranges form an atom, so that the sizes are a bounded table however many groups there are; with
    65,536 atoms a shard of 1/24 exceeds the mean by 0.04 % at most, unless one group of equal texts is larger.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    The slot is a row's number in its shard: rows of earlier atoms of the shard, rows of earlier cells of its atom,
    then its number in the cell. A cell is the part of an atom that a hash of doc_id deals out, ``cell`` rows on
    average, so a group with a third of all rows is numbered by many tasks.
    A null text counts no bytes and goes with the empty text. Rows with equal or null doc_id each get a slot. An empty
    table gives no rows; there may be empty shards when there are fewer groups than shards.
    """
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    spread = F.pmod(F.xxhash64(text), F.lit(atoms)).cast("int")
    rows = scratch.write(
        docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), spread.alias("atom"), F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(7)).alias("deal")),
        "rows",
    )
    found = {r.atom: (r.bytes, r.n) for r in rows.groupBy("atom").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    present = sorted(found)
    _, cuts = minimax([found[a][0] for a in present], shards) if present else (0, [])
    table, starts = [], set(cuts)
    shard = slot = 0
    for i, a in enumerate(present):
        if i in starts:
            shard, slot = max(s for s, c in enumerate(cuts) if c == i), 0
        table.append((a, shard, slot, max(1, -(-found[a][1] // cell))))
        slot += found[a][1]
    where = F.broadcast(spark.createDataFrame(table, "atom int, shard int, base long, cells int"))  # at most `atoms` rows
    dealt = rows.join(where, "atom").withColumn("cell", F.pmod("deal", F.col("cells")).cast("int"))
    counts = dealt.where("cells > 1").groupBy("atom", "cell").agg(F.count("*").alias("n"))
    before = counts.select("atom", "cell", F.coalesce(F.sum("n").over(Window.partitionBy("atom").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("atom", "cell").orderBy("doc_id", "text_crc32", "size"))
    numbered = dealt.select("*", nth.alias("nth")).join(before, ["atom", "cell"], "left")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.coalesce("before", F.lit(0)) + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    return shard_rows(spark, take(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text"))
