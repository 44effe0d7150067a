"""Neighbor lists: periodic range joins within systems.

Edges are directed and both directions are present: system_id, i, j, shift (sx, sy, sz), vector (dx, dy, dz) = r_j - r_i +
shift . cell, and r2. Distances are strictly below the cutoff. Particles need particle_id, system_id, x, y, z and may have
inclusion_id (pairs must agree; the system by default) and exclusion_id (pairs must differ; the particle by default).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import CELL, cell, dot, minus, perpendicular, plus, to_fractional, to_real, vec

EDGE = ["system_id", "i", "j", "sx", "sy", "sz", "dx", "dy", "dz", "r2"]


def _placed(particles: DataFrame, systems: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Particles with fractional coordinates, inclusion and exclusion, and their system's cell and cutoff."""
    inclusion = F.col("inclusion_id") if "inclusion_id" in particles.columns else F.col("system_id")
    exclusion = F.col("exclusion_id") if "exclusion_id" in particles.columns else F.col("particle_id")
    own = particles.select("particle_id", "system_id", inclusion.alias("inc"), exclusion.alias("exc"), "x", "y", "z", *carry)
    return own.join(systems.select("system_id", *CELL, "cutoff"), "system_id").withColumns(dict(zip(("fa", "fb", "fc"), to_fractional(vec(), cell()), strict=True)))


def _side(placed: DataFrame, side: str, *more: str) -> DataFrame:
    keep = ["particle_id", "inc", "exc", "fa", "fb", "fc", *more]
    return placed.select("system_id", *(F.col(c).alias(f"{side}_{c}") for c in keep))


def cells_per_axis(h: tuple[Column, ...], cutoff: Column) -> tuple[Column, ...]:
    return tuple(F.greatest(F.lit(1), F.floor(p / cutoff).cast("int")) for p in perpendicular(h))


def _candidates(placed: DataFrame, strategy: str, ids: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of particles of one system that may be near: all of the system, or those of the 27 cells around.

    With ``ids`` (particle_id), only pairs whose first particle is one of them.
    """
    dims = [*CELL, "cutoff"]
    of = (lambda df: df) if ids is None else (lambda df: df.join(ids, "particle_id", "left_semi"))
    if strategy == "all":  # every pair of particles, then one system: for tests
        left, right = _side(of(placed), "l", *carry), _side(placed, "r", *dims, *carry).withColumnRenamed("system_id", "r_system_id")
        out = left.join(right, F.col("system_id") == F.col("r_system_id") + F.lit(0)).drop("r_system_id")
    elif strategy == "dense":
        out = _side(of(placed), "l", *carry).join(_side(placed, "r", *dims, *carry), "system_id")
    else:
        n = cells_per_axis(cell(), F.col("cutoff"))
        at = [F.least(F.floor(F.pmod(F.col(f), F.lit(1.0)) * k).cast("int"), k - 1) for f, k in zip(("fa", "fb", "fc"), n, strict=True)]
        binned = placed.withColumns({f"c{a}": c for a, c in zip("abc", at, strict=True)} | {f"n{a}": k for a, k in zip("abc", n, strict=True)})
        left = _side(of(binned), "l", "ca", "cb", "cc", "na", "nb", "nc", *carry)
        for a in "abc":  # distinct cells only: an axis of one or two cells is its own neighbor
            around = F.array(*(F.pmod(F.col(f"l_c{a}") + d, F.col(f"l_n{a}")) for d in (-1, 0, 1)))
            left = left.withColumn(f"k{a}", F.explode(F.array_distinct(around)))
        right = _side(binned, "r", *dims, "ca", "cb", "cc", *carry).withColumnsRenamed({f"r_c{a}": f"k{a}" for a in "abc"})
        out = left.join(right, ["system_id", "ka", "kb", "kc"])
    return out.withColumnsRenamed({f"r_{d}": d for d in dims})


def neighbor_list(particles: DataFrame, systems: DataFrame, strategy: str = "auto", images: bool = True, of: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Edges below each system's cutoff; with ``of`` (particle_id), those that start at one of these particles.

    Columns of the particles named in ``carry`` come along as <column>_i and <column>_j, which spares a join of the edges.
    ``strategy``: ``cell`` joins on grid cells (work in proportion to the particles), ``dense`` on the system, ``all`` is
    for tests; ``auto`` takes cells if some system has a cutoff below 0.3 of its cell. With ``images``, a cutoff of more
    than half the cell also finds further images; exclusion then suppresses the nearest image only. An empty table gives
    no edges; particles whose system is null or unknown have none.
    """
    if strategy == "auto":
        least = F.least(*perpendicular(cell()))
        strategy = "dense" if systems.where(F.col("cutoff") < 0.3 * least).isEmpty() else "cell"
    pairs = _candidates(_placed(particles, systems, carry), strategy, of, carry).where("l_inc = r_inc")
    l, r = tuple(F.col(f"l_f{a}") for a in "abc"), tuple(F.col(f"r_f{a}") for a in "abc")
    shift = [F.rint(a - b) for a, b in zip(l, r, strict=True)]
    excluded = F.col("l_exc") == F.col("r_exc")
    if images:
        half = [F.when(2 * F.col("cutoff") > p, F.floor(F.ceil(2 * F.col("cutoff") / p) / 2)).otherwise(0).cast("int") for p in perpendicular(cell())]
        for a, h in zip("abc", half, strict=True):
            pairs = pairs.withColumn(f"o{a}", F.explode(F.sequence(-h, h)))
        nearest = (F.col("oa") == 0) & (F.col("ob") == 0) & (F.col("oc") == 0)
        shift = [s + F.col(f"o{a}") for s, a in zip(shift, "abc", strict=True)]
        pairs = pairs.where(~(excluded & nearest))
    else:
        pairs = pairs.where(~excluded)
    d = to_real(tuple(b - a + s for a, b, s in zip(l, r, shift, strict=True)), cell())
    made = pairs.select("system_id", F.col("l_particle_id").alias("i"), F.col("r_particle_id").alias("j"), *(s.cast("int").alias(f"s{a}") for s, a in zip(shift, "xyz", strict=True)), *(c.alias(f"d{a}") for c, a in zip(d, "xyz", strict=True)), "cutoff", *(F.col(f"{side}_{c}").alias(f"{c}_{k}") for c in carry for side, k in (("l", "i"), ("r", "j"))))
    return made.withColumn("r2", dot(vec("d"), vec("d"))).where(F.col("r2") < F.col("cutoff") * F.col("cutoff")).select(*EDGE, *(f"{c}_{k}" for c in carry for k in "ij"))


def refine_mask(edges: DataFrame, particles: DataFrame) -> DataFrame:
    """Edges of a wider list whose ends agree in inclusion and differ in exclusion."""
    side = lambda k: particles.select(F.col("particle_id").alias(k), F.col("inclusion_id").alias(f"_inc_{k}"), F.col("exclusion_id").alias(f"_exc_{k}"))
    return edges.join(side("i"), "i").join(side("j"), "j").where("_inc_i = _inc_j and _exc_i <> _exc_j").select(*edges.columns)


def refine_cutoff(edges: DataFrame, systems: DataFrame) -> DataFrame:
    """Edges of a wider list that are below the given cutoffs."""
    return edges.join(systems.select("system_id", F.col("cutoff").alias("_cut")), "system_id").where("r2 < _cut * _cut").select(*edges.columns)


def all_connected(particles: DataFrame) -> DataFrame:
    """Both directions of every pair with one inclusion and different exclusion, whatever the distance; shift 0."""
    left = particles.select("system_id", F.col("inclusion_id").alias("_inc"), F.col("particle_id").alias("i"), F.col("exclusion_id").alias("_ei"))
    right = particles.select("system_id", F.col("inclusion_id").alias("_inc"), F.col("particle_id").alias("j"), F.col("exclusion_id").alias("_ej"))
    return left.join(right, ["system_id", "_inc"]).where("_ei <> _ej and i <> j").select("system_id", "i", "j", *(F.lit(0).alias(f"s{a}") for a in "xyz"))


def with_vectors(edges: DataFrame, particles: DataFrame, systems: DataFrame) -> DataFrame:
    """Vectors and squared distances of edges with shifts (system_id, i, j, sx, sy, sz)."""
    end = lambda k: particles.select(F.col("particle_id").alias(k), *(F.col(a).alias(f"_{k}{a}") for a in "xyz"))
    placed = edges.join(end("i"), "i").join(end("j"), "j").join(systems.select("system_id", *CELL), "system_id")
    d = plus(minus(vec("_j"), vec("_i")), to_real(vec("s"), cell()))
    made = placed.select(*edges.columns, *(c.alias(f"d{a}") for c, a in zip(d, "xyz", strict=True)))
    return made.withColumn("r2", dot(vec("d"), vec("d")))


def changes(particles: DataFrame, moved: DataFrame, systems: DataFrame, strategy: str = "dense", images: bool = True, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges that appear and edges that vanish when the rows of ``moved`` replace those of ``particles``.

    Only pairs with a changed particle are searched: those that start at one, and the other direction of those that end
    at one that stays. ``images`` is that of the list which is brought up to date. An edge whose
    squared distance changes is another one; with ``digits``, only if it differs when rounded to so many decimals, so
    that the last bits of two particles moved alike don't count.
    """
    ids = moved.select("particle_id")
    still = particles.join(ids, "particle_id", "left_anti")
    new = still.unionByName(moved.select(*particles.columns))

    def around(table: DataFrame) -> DataFrame:
        edges = neighbor_list(table, systems, strategy, images, ids)
        back = edges.join(ids.withColumnRenamed("particle_id", "j"), "j", "left_anti")
        turned = [F.col("j").alias("i"), F.col("i").alias("j"), *((-F.col(c)).alias(c) for c in EDGE[3:9])]
        return edges.union(back.select("system_id", *turned, "r2"))

    before, after = around(particles), around(new)
    key = ["system_id", "i", "j", "sx", "sy", "sz", "_r2"]
    before, after = (t.withColumn("_r2", F.col("r2") if digits is None else F.round("r2", digits)) for t in (before, after))
    return after.join(before.select(*key), key, "left_anti").select(*EDGE), before.join(after.select(*key), key, "left_anti").select(*EDGE)


def supercell(particles: DataFrame, systems: DataFrame, na: int, nb: int, nc: int) -> tuple[DataFrame, DataFrame]:
    """Copies of every particle along the cell's axes, and the larger cell. Copies of id p are p * copies + number."""
    n = na * nb * nc
    shifts = particles.sparkSession.range(n).select(F.col("id").alias("_n"), (F.col("id") % na).cast("double").alias("_a"), (F.floor(F.col("id") / na) % nb).cast("double").alias("_b"), F.floor(F.col("id") / (na * nb)).cast("double").alias("_c"))
    placed = particles.join(systems.select("system_id", *CELL), "system_id").crossJoin(F.broadcast(shifts))
    moved = plus(vec(), to_real((F.col("_a"), F.col("_b"), F.col("_c")), cell()))
    rest = [c for c in particles.columns if c not in ("particle_id", "x", "y", "z")]
    out = placed.select((F.col("particle_id") * n + F.col("_n")).alias("particle_id"), *rest, *(c.alias(a) for c, a in zip(moved, "xyz", strict=True)))
    by = {"ax": na, "bx": nb, "by": nb, "cx": nc, "cy": nc, "cz": nc}
    return out, systems.withColumns({c: F.col(c) * k for c, k in by.items()})
