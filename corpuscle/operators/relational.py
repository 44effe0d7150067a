"""The relational core: keyed tables, foreign-key gathers, checked joins, conditional updates, re-keying unions.

A table is a DataFrame with a declared key column; a foreign key is a plain column, null where it points nowhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Fill = dict[str, object]


# --- tables ------------------------------------------------------------------------------------------------------


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Raises if a key occurs twice."""
    if twice := df.groupBy(*keys).count().where("count > 1").head(3):
        raise ValueError(f"repeated keys of {', '.join(keys)}: {[r.asDict() for r in twice]}")
    return df


def arange(df: DataFrame, order: list[str], key: str = "key", buckets: int = 0) -> DataFrame:
    """Adds keys 0, 1, ... in the given order, without gathering all rows in one task.

    Rows are range-partitioned by the order; the offset of each range comes from the counts of the ranges.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(starts.select("_part", "_start")), "_part").withColumn(key, F.col("_start") + F.col("_nth") - 1).drop("_part", "_start", "_nth")


def slice_rows(df: DataFrame, order: list[str], start: int = 0, end: int | None = None, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... before end, in the given order; keys stay as they are."""
    at = F.col("_at")
    keep = (at >= start) & ((at - start) % step == 0)
    return arange(df, order, "_at").where(keep if end is None else keep & (at < end)).drop("_at")


def subset(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, order: list[str]) -> DataFrame:
    """Gathers the rows named by ``wanted`` and gives them keys 0, 1, ... in the given order."""
    picked = wanted.join(df.withColumnRenamed(key, "_old"), F.col(f"`{wanted_key}`") == F.col("_old"), "inner")
    return arange(picked, order, key)


def contains(df: DataFrame, key: str, value: object) -> bool:
    return not df.where(F.col(key) == F.lit(value)).isEmpty()


def transform(tables: list[DataFrame], key: str, **columns: Column) -> DataFrame:
    """Element-wise expressions over tables with one key set, which is checked."""
    return join_checked(tables[0], *tables[1:], key=key).select(key, *(c.alias(n) for n, c in columns.items()))


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b), "//": lambda a, b: F.floor(F.try_divide(a, b)), ">": lambda a, b: a > b}


def arithmetic(left: DataFrame, right: DataFrame | float, key: str, value: str, op: str) -> DataFrame:
    """Table with table (one key set, checked) or table with number."""
    if not isinstance(right, DataFrame):
        return left.select(key, ARITHMETIC[op](F.col(value), F.lit(right)).alias(value))
    both = join_checked(left.select(key, value), right.select(key, F.col(value).alias("_other")), key=key)
    return both.select(key, ARITHMETIC[op](F.col(value), F.col("_other")).alias(value))


# --- joins -------------------------------------------------------------------------------------------------------


def gather(child: DataFrame, fk: str, parent: DataFrame, key: str, fill: Fill | None = None) -> DataFrame:
    """Parent columns for each child row; where the key is null or unknown, ``fill`` (else null)."""
    out = child.join(parent.withColumnRenamed(key, "_key"), F.col(f"`{fk}`") == F.col("_key"), "left").drop("_key")
    return out.fillna(fill) if fill else out


def gather_path(child: DataFrame, *steps: tuple[str, DataFrame, str]) -> DataFrame:
    """Chained gathers: each step is (foreign key, parent, its key)."""
    return reduce(lambda df, s: gather(df, s[0], s[1], s[2]), steps, child)


def join_checked(base: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """One-to-one join of tables whose key sets must be the same; raises otherwise."""
    out = base
    for other in others:
        keys = base.select(key).withColumn("_a", F.lit(1)).join(other.select(key).withColumn("_b", F.lit(1)), key, "full_outer")
        if lost := keys.where("_a is null or _b is null").head(3):
            raise ValueError(f"key sets differ: {[r.asDict() for r in lost]}")
        out = out.join(other, key)
    return out


def broadcast_row(df: DataFrame, single: DataFrame) -> DataFrame:
    """Repeats the columns of a one-row table on every row; raises if it has more or none."""
    if single.limit(2).count() != 1:
        raise ValueError("a table of exactly one row is needed")
    return df.crossJoin(F.broadcast(single))


def subselect(needles: DataFrame, haystack: DataFrame, key: str) -> DataFrame:
    """All pairs of rows with equal key."""
    return needles.where(F.col(key).isNotNull()).join(haystack, key)


def isin(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """Rows whose value is a key of the other table."""
    return df.join(other.select(F.col(key).alias("_in")).distinct(), F.col(column) == F.col("_in"), "left_semi")


def not_in(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(F.col(key).alias("_in")).distinct(), F.col(column) == F.col("_in"), "left_anti")


# --- foreign keys ------------------------------------------------------------------------------------------------


def apply_mask(df: DataFrame, fk: str, mask: Column) -> DataFrame:
    """The foreign key where the mask holds, else null."""
    return df.withColumn(fk, F.when(mask, F.col(fk)))


def where_per_key(df: DataFrame, key: str, order: list[str], most: int, position: str = "pos") -> DataFrame:
    """First ``most`` rows of each key, with their place in it."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.where(F.col(key).isNotNull()).withColumn(position, nth).where(F.col(position) < most)


def kth_per_key(df: DataFrame, key: str, order: list[str], k: DataFrame, k_column: str = "k") -> DataFrame:
    """For each row (key, k) the (k mod count)-th occurrence of the key; nulls where there is none."""
    w = Window.partitionBy(key)
    ranked = df.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    wanted = k.select(F.col(key), F.col(k_column))
    r = ranked.withColumnRenamed(key, "_key")
    return wanted.join(r, (F.col(key) == F.col("_key")) & (F.pmod(F.col(k_column), F.col("_n")) == F.col("_nth")), "left").drop("_key", "_nth", "_n")


def encode(df: DataFrame, column: str, code: str = "code") -> tuple[DataFrame, DataFrame]:
    """Sorted vocabulary of a column and the rows with their place in it."""
    words = arange(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], code)
    return df.join(words, column, "left"), words


def lookup(df: DataFrame, column: str, words: DataFrame, key: str, code: str = "code", missing: bool = False) -> DataFrame:
    """Code of each value; raises for values that the vocabulary lacks unless ``missing``."""
    if not missing and (lost := not_in(df.where(F.col(column).isNotNull()), column, words, key).head(1)):
        raise KeyError(f"not in the vocabulary: {lost[0][column]}")
    return gather(df, column, words.select(F.col(key), F.col(code)), key)


# --- updates -----------------------------------------------------------------------------------------------------


def update(df: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Writes the rows of ``changes`` (key and some columns) over those of one key; others stay."""
    new = [c for c in changes.columns if c != key]
    delta = changes.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in new))
    kept = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns]
    return df.join(delta, key, "left").select(*kept)


def update_if(df: DataFrame, key: str, changes: DataFrame, accept: DataFrame, owner: str = "system_id", flag: str = "accept") -> DataFrame:
    """Writes the changes whose owner is accepted: the owner of the present row or that of the new one.

    A row without owner is free; it is written if the new owner is accepted.
    """
    old = df.select(key, F.col(owner).alias("_old"))
    ok = accept.where(F.col(flag)).select(F.col(owner).alias("_ok"))
    new_owner = F.col(owner) if owner in changes.columns else F.col("_old")
    delta = changes.join(old, key).withColumn("_new", new_owner)
    a = ok.withColumnRenamed("_ok", "_ok_old").withColumn("_a", F.lit(True))
    b = ok.withColumnRenamed("_ok", "_ok_new").withColumn("_b", F.lit(True))
    hit = delta.join(a, F.col("_old") == F.col("_ok_old"), "left").join(b, F.col("_new") == F.col("_ok_new"), "left").where(F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False)))
    return update(df, key, hit.select(*changes.columns))


def select_free(df: DataFrame, owner: str, order: str, n: int) -> DataFrame:
    """First ``n`` rows without owner."""
    return df.where(F.col(owner).isNull()).orderBy(order).limit(n)


def pad(df: DataFrame, key: str, n: int) -> DataFrame:
    """Adds ``n`` free rows: all null but for the next keys."""
    top = df.agg(F.max(key).alias("_top"))
    free = df.sparkSession.range(1, n + 1).crossJoin(F.broadcast(top)).select((F.coalesce("_top", F.lit(-1)) + F.col("id")).alias(key))
    return df.unionByName(free, allowMissingColumns=True)


# --- groups ------------------------------------------------------------------------------------------------------


def group_sum(df: DataFrame, fk: str, values: list[str], keys: DataFrame, key: str) -> DataFrame:
    """Sum for every key, 0 for keys without rows; rows without key are left out."""
    sums = df.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias(key)).agg(*(F.sum(v).alias(v) for v in values))
    return keys.select(key).join(sums, key, "left").fillna(0, values)


def group_count(df: DataFrame, fk: str, keys: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows of every key, 0 for keys without rows."""
    counts = df.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias(key)).agg(F.count("*").alias(name))
    return keys.select(key).join(counts, key, "left").fillna(0, [name])


def contingency(df: DataFrame, rows: DataFrame, columns: DataFrame, row_key: str, column_key: str, name: str = "n") -> DataFrame:
    """Counts of every pair of keys of the two (small) dimension tables, zeros kept."""
    counts = df.groupBy(row_key, column_key).agg(F.count("*").alias(name))
    return rows.select(row_key).crossJoin(F.broadcast(columns.select(column_key))).join(counts, [row_key, column_key], "left").fillna(0, [name])


def offsets(counts: DataFrame, key: str, n: str = "n", name: str = "offset") -> DataFrame:
    """Exclusive running sum of counts, by key: sums within ranges of keys, and the sums of earlier ranges."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = counts.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id())
    sums = ranged.groupBy("_part").agg(F.sum(n).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.withColumn(name, inside).join(sums.select("_part", before.alias("_before")), "_part")
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


# --- unions ------------------------------------------------------------------------------------------------------


def union_rekey(groups: list[dict[str, DataFrame]], keys: dict[str, str], references: dict[tuple[str, str], str]) -> dict[str, DataFrame]:
    """UNION ALL of several databases: keys of each table are shifted past those of earlier ones, references alike.

    ``keys``: table -> key column. ``references``: (table, foreign key) -> table that it points to. Null stays null.
    """
    sizes = {t: [g[t].agg((F.coalesce(F.max(k), F.lit(-1)) + 1).alias("n")).first().n for g in groups] for t, k in keys.items()}
    shift = {t: [sum(s[:i]) for i in range(len(s))] for t, s in sizes.items()}
    out = {}
    for t, k in keys.items():
        parts = []
        for i, g in enumerate(groups):
            moved = {k: shift[t][i], **{fk: shift[to][i] for (own, fk), to in references.items() if own == t}}
            parts.append(g[t].select(*((F.col(c) + F.lit(moved[c])).alias(c) if c in moved else F.col(c) for c in g[t].columns)))
        out[t] = reduce(DataFrame.unionByName, parts)
    return out
