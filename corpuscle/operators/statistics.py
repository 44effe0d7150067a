"""Statistics of time series: block averages, exponential averages, drift, and the analyses built on them.

Series have system_id, step and value columns; rows are ordered by step within a system.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BOLTZMANN


def numbered(series: DataFrame) -> DataFrame:
    """Adds the row's number in its system (from 0) and the system's rows."""
    w = Window.partitionBy("system_id")
    return series.withColumn("_nth", F.row_number().over(w.orderBy("step")) - 1).withColumn("_rows", F.count("*").over(w))


def block_means(series: DataFrame, n_blocks: int, values: list[str]) -> DataFrame:
    """Means of n_blocks equal blocks; the rows that don't fill a block are left out. Systems with fewer rows have none."""
    size = F.floor(F.col("_rows") / n_blocks)
    inside = numbered(series).where(F.col("_rows") >= n_blocks).withColumn("block", F.floor(F.col("_nth") / size)).where(F.col("block") < n_blocks)
    return inside.groupBy("system_id", "block").agg(*(F.avg(v).alias(v) for v in values))


def from_blocks(blocks: DataFrame, values: list[str]) -> DataFrame:
    """Mean and its standard error from block values; one block has no error (null)."""
    n = F.sqrt(F.count("*").cast("double"))
    return blocks.groupBy("system_id").agg(*(c for v in values for c in (F.avg(v).alias(f"{v}_mean"), (F.stddev_samp(v) / n).alias(f"{v}_sem"))))


def block_average(series: DataFrame, n_blocks: int, values: list[str]) -> DataFrame:
    return from_blocks(block_means(series, n_blocks, values), values)


def block_transform(series: DataFrame, value: str, min_blocks: int = 4) -> DataFrame:
    """Standard error for n/2, n/4, ... blocks (blocks of 2, 4, ... rows), down to ``min_blocks`` blocks."""
    base = numbered(series).select("system_id", "_nth", "_rows", value)
    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.log2(F.greatest(F.lit(2), F.col("_rows")) / min_blocks) + 1e-9).cast("int")))
    wide = base.where(F.col("_rows") >= 2 * min_blocks).withColumn("level", F.explode(levels)).withColumn("size", F.pow(F.lit(2.0), F.col("level")).cast("long"))
    blocks = wide.withColumn("n_blocks", F.floor(F.col("_rows") / F.col("size"))).withColumn("block", F.floor(F.col("_nth") / F.col("size"))).where("block < n_blocks and n_blocks >= " + str(min_blocks))
    means = blocks.groupBy("system_id", "size", "n_blocks", "block").agg(F.avg(value).alias("m"))
    return means.groupBy("system_id", "size", "n_blocks").agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("*").cast("double"))).alias("sem"))


def optimal_block_average(series: DataFrame, value: str, min_blocks: int = 4, rtol: float = 0.05) -> DataFrame:
    """Standard error at the first plateau: where it changes by less than ``rtol``, the next level; else the last."""
    t = block_transform(series, value, min_blocks)
    w = Window.partitionBy("system_id").orderBy("size")
    change = F.abs(F.lead("sem").over(w) - F.col("sem")) / (F.abs("sem") + 1e-10)
    marked = t.withColumn("flat", change < rtol).withColumn("after", F.lag("flat").over(w))
    first = marked.groupBy("system_id").agg(F.coalesce(F.min(F.when(F.col("after"), F.col("size"))), F.max("size")).alias("size"))
    return t.join(first, ["system_id", "size"]).select("system_id", "size", "n_blocks", "mean", "sem")


def ema(series: DataFrame, value: str, alpha: float, name: str = "ema") -> DataFrame:
    """Last value of the average x <- alpha x + v, w <- alpha w + 1, x / w, in closed form: two sums for each system."""
    weight = F.pow(F.lit(alpha), F.col("_rows") - 1 - F.col("_nth"))
    return numbered(series).groupBy("system_id").agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias(name))


def drift(series: DataFrame, value: str, name: str = "drift") -> DataFrame:
    """Least-squares slope against the step."""
    return series.groupBy("system_id").agg(F.regr_slope(F.col(value), F.col("step").cast("double")).alias(name))


def ring_mean(series: DataFrame, value: str, length: int, name: str = "ring_mean") -> DataFrame:
    """Mean of a ring buffer that begins with zeros: the last ``length`` values over length, not over their number."""
    w = Window.partitionBy("system_id").orderBy("step").rowsBetween(-(length - 1), 0)
    return series.withColumn(name, F.sum(value).over(w) / length)


def half_means(series: DataFrame, value: str) -> DataFrame:
    """Means of the first and the last half of each system's rows."""
    return numbered(series).groupBy("system_id").agg(F.avg(F.when(2 * F.col("_nth") < F.col("_rows"), F.col(value))).alias("first_half"), F.avg(F.when(2 * F.col("_nth") >= F.col("_rows"), F.col(value))).alias("last_half"))


def trace(stress: Column) -> Column:
    """Trace of a 3 x 3 matrix in an array of nine."""
    return F.get(stress, 0) + F.get(stress, 4) + F.get(stress, 8)


def md_analysis(steps: DataFrame, atoms: DataFrame, n_blocks: int = 10) -> DataFrame:
    """Block statistics of energies, temperature and pressure, and the drift of the total energy.

    ``steps``: system_id, step, potential_energy, kinetic_energy, stress; ``atoms``: system_id, n_atoms.
    """
    full = steps.join(atoms, "system_id").select(
        "system_id", "step", "potential_energy", "kinetic_energy", (F.col("potential_energy") + F.col("kinetic_energy")).alias("total_energy"),
        F.try_divide(2 * F.col("kinetic_energy"), BOLTZMANN * (3 * F.col("n_atoms") - 3)).alias("temperature"), (trace(F.col("stress")) / 3).alias("pressure"),
    )
    values = ["potential_energy", "kinetic_energy", "total_energy", "temperature", "pressure"]
    return block_average(full, n_blocks, values).join(drift(full, "total_energy"), "system_id")


def mc_analysis(steps: DataFrame, counts: DataFrame, temperatures: DataFrame, n_blocks: int = 10) -> DataFrame:
    """Energy, loading and heat of adsorption of one species: per block (<UN> - <U><N>) / (<NN> - <N><N>) - kT.

    A constant number of molecules has no heat (null).
    """
    both = steps.join(counts, ["system_id", "step"]).select("system_id", "step", F.col("potential_energy").alias("u"), F.col("n").cast("double").alias("n"))
    both = both.withColumn("un", F.col("u") * F.col("n")).withColumn("nn", F.col("n") * F.col("n"))
    blocks = block_means(both, n_blocks, ["u", "n", "un", "nn"]).join(temperatures, "system_id")
    spread = F.col("nn") - F.col("n") * F.col("n")
    heat = F.when(F.abs(spread) > 1e-12, (F.col("un") - F.col("u") * F.col("n")) / F.when(F.abs(spread) > 1e-12, spread)) - BOLTZMANN * F.col("temperature")
    return from_blocks(blocks.select("system_id", F.col("u").alias("energy"), F.col("n").alias("loading"), heat.alias("heat")), ["energy", "loading", "heat"])


def mixture_heats(steps: DataFrame, counts: DataFrame, temperatures: DataFrame, n_blocks: int = 10) -> DataFrame:
    """Heats of adsorption of several species: cov(U, N) times the inverse covariance of the numbers, per block.

    The sums are DataFrame aggregates; only the k x k inverse of each block, a bounded matrix, is a grouped function.
    """
    import pandas as pd

    number = F.col("n").cast("double")
    u = steps.select("system_id", "step", F.col("potential_energy").alias("u"))
    sized = numbered(u).where(F.col("_rows") >= n_blocks).withColumn("block", F.floor(F.col("_nth") / F.floor(F.col("_rows") / n_blocks))).where(F.col("block") < n_blocks)
    rows = sized.join(counts.select("system_id", "step", F.col("motif_id").alias("a"), number.alias("na")), ["system_id", "step"])
    pairs = rows.join(counts.select("system_id", "step", F.col("motif_id").alias("b"), number.alias("nb")), ["system_id", "step"])
    sums = pairs.groupBy("system_id", "block", "a", "b").agg(F.avg("u").alias("u"), F.avg("na").alias("na"), F.avg("nb").alias("nb"), F.avg(F.col("na") * F.col("nb")).alias("nn"), F.avg(F.col("u") * F.col("na")).alias("un"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        cov = (pdf.nn - pdf.na * pdf.nb).to_numpy()
        species = sorted(pdf.a.unique())
        m = pd.Series(cov, index=pd.MultiIndex.from_arrays([pdf.a, pdf.b])).unstack().loc[species, species].to_numpy()
        first = pdf.drop_duplicates("a").set_index("a").loc[species]
        un = (first.un - first.u * first.na).to_numpy()
        heat = np.linalg.solve(m, un) if abs(np.linalg.det(m)) > 1e-12 else np.full(len(species), np.nan)
        return pd.DataFrame({"system_id": pdf.system_id.iloc[0], "block": pdf.block.iloc[0], "motif_id": species, "heat": heat})

    solved = sums.groupBy("system_id", "block").applyInPandas(solve, "system_id long, block long, motif_id long, heat double").join(temperatures, "system_id")
    heat = solved.withColumn("heat", F.nanvl("heat", F.lit(None)) - BOLTZMANN * F.col("temperature"))
    return heat.groupBy("system_id", "motif_id").agg(F.avg("heat").alias("heat_mean"), (F.stddev_samp("heat") / F.sqrt(F.count("heat").cast("double"))).alias("heat_sem"))


def relax_analysis(steps: DataFrame) -> DataFrame:
    """Last step's energy and largest force, and the number of steps."""
    last = F.max_by(F.struct("potential_energy", "max_force"), "step")
    return steps.groupBy("system_id").agg(last.alias("x"), F.max("step").alias("last_step")).select("system_id", F.col("x.potential_energy").alias("energy"), F.col("x.max_force").alias("max_force"), (F.col("last_step") + 1).alias("n_steps"))
