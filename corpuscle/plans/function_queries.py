"""Queries of the Column functions, the set operations and the smaller operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BOLTZMANN
from ..functions import geometry as geo
from ..operators import energies, neighbors, observables, relational
from . import dynamics, montecarlo
from .queries import EDGES_SQL, P, particles, query, species, systems, table

# --- relational core ----------------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS c_custkey, c_name, o_orderkey FROM (SELECT c_custkey, c_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 1000 = 1 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) = 1)")
def subset(spark: SparkSession, d: str) -> DataFrame:
    """Customers of some orders, renumbered in their old order."""
    o = table(spark, d, "orders").where("o_orderkey % 1000 = 1").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return relational.subset(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", o, "o_custkey", ["o_custkey"]).select("c_custkey", "c_name", "o_orderkey")


@query("SELECT 1 AS key, (SELECT count(*) FROM customer WHERE c_custkey = 1) > 0 AS found UNION ALL SELECT -7, (SELECT count(*) FROM customer WHERE c_custkey = -7) > 0")
def contains(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return spark.createDataFrame([(k, relational.contains(c, "c_custkey", k)) for k in (1, -7)], "key int, found boolean")


@query("SELECT s_suppkey, round(s_acctbal * 2 + s_nationkey, 2) AS v FROM supplier")
def transform(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return relational.transform([s.select("s_suppkey", "s_acctbal"), s.select("s_suppkey", "s_nationkey")], "s_suppkey", v=F.round(F.col("s_acctbal") * 2 + F.col("s_nationkey"), 2))


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region UNION ALL SELECT (SELECT max(r_regionkey) FROM region) + 1 + unnest(range(3)), NULL")
def pad(spark: SparkSession, d: str) -> DataFrame:
    return relational.pad(table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name"), "r_regionkey", 3)


@query("SELECT o_custkey, max(o_totalprice) AS most FROM orders GROUP BY 1")
def group_max(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select("o_custkey"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_totalprice WHEN o_totalprice > 100000 THEN 100000.0::DOUBLE ELSE NULL END AS v FROM orders")
def where_select(spark: SparkSession, d: str) -> DataFrame:
    """Conditional select among several columns, by condition."""
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(price > 200000, price).when(price > 100000, F.lit(100000.0)).alias("v"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS nth FROM orders")
def sorted_within(spark: SparkSession, d: str) -> DataFrame:
    """Stable order of the rows of each key."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")) - 1
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", nth.cast("long").alias("nth"))


@query("SELECT c_custkey AS key, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def union_stack(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("kind"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("kind")))


# --- cells --------------------------------------------------------------------------------------------------------

CELLS = """c AS (SELECT s_suppkey AS k, 5.0::DOUBLE + s_suppkey % 7 AS a, 6.0::DOUBLE + s_suppkey % 5 AS b, 7.0::DOUBLE + s_suppkey % 3 AS c, radians(70.0::DOUBLE + 10 * (s_suppkey % 4)) AS al, radians(80.0::DOUBLE + 5 * (s_suppkey % 5)) AS be, radians(75.0::DOUBLE + 6 * (s_suppkey % 6)) AS ga FROM supplier),
l0 AS (SELECT *, c * (cos(al) - cos(be) * cos(ga)) / sin(ga) AS cy_ FROM c),
l AS (SELECT k, a AS ax, b * cos(ga) AS bx, b * sin(ga) AS by_, c * cos(be) AS cx, cy_ AS cy, sqrt(c * c - (c * cos(be)) * (c * cos(be)) - cy_ * cy_) AS cz FROM l0)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    edges = [F.lit(5.0) + k % 7, F.lit(6.0) + k % 5, F.lit(7.0) + k % 3]
    angles = [F.lit(70.0) + 10 * (k % 4), F.lit(80.0) + 5 * (k % 5), F.lit(75.0) + 6 * (k % 6)]
    return table(spark, d, "supplier").select(k.alias("k"), *(v.alias(n) for n, v in geo.lattice(*edges, *angles).items()))


def _rounded(df: DataFrame, key: str, **columns: F.Column) -> DataFrame:  # type: ignore[name-defined]
    return df.select(key, *(F.round(c, 7).alias(n) for n, c in columns.items()))


@query(f"WITH {CELLS} SELECT k, round(ax, 7) AS ax, round(bx, 7) AS bx, round(by_, 7) AS by, round(cx, 7) AS cx, round(cy, 7) AS cy, round(cz, 7) AS cz FROM l")
def lattice(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(cells(spark, d), "k", **{n: F.col(n) for n in ("ax", "bx", "by", "cx", "cy", "cz")})


PERP = """ax * by_ * cz / sqrt((by_ * cz) * (by_ * cz) + (bx * cz) * (bx * cz) + (bx * cy - by_ * cx) * (bx * cy - by_ * cx)) AS pa,
ax * by_ * cz / sqrt((ax * cz) * (ax * cz) + (ax * cy) * (ax * cy)) AS pb, cz AS pc"""


@query(f"WITH {CELLS}, q AS (SELECT k, {PERP} FROM l) SELECT k, round(pa, 7) AS pa, round(pb, 7) AS pb, round(pc, 7) AS pc FROM q")
def perpendicular_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(cells(spark, d), "k", **dict(zip(("pa", "pb", "pc"), geo.perpendicular(geo.cell()), strict=True)))


@query(f"WITH {CELLS}, q AS (SELECT k, {PERP} FROM l) SELECT k, ceil(24.3::DOUBLE / pa)::INTEGER AS na, ceil(24.3::DOUBLE / pb)::INTEGER AS nb, ceil(24.3::DOUBLE / pc)::INTEGER AS nc FROM q")
def min_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    n = geo.min_multiplicity(geo.cell(), F.lit(12.15))
    return cells(spark, d).select("k", *(c.alias(a) for c, a in zip(n, ("na", "nb", "nc"), strict=True)))


@query(f"WITH {CELLS} SELECT k, round(1 / ax, 7) AS ia, round(-bx / (ax * by_), 7) AS ib, round((bx * cy - cx * by_) / (ax * by_ * cz), 7) AS ic, round(ax * by_ * cz, 7) AS det FROM l")
def triangular_inverse(spark: SparkSession, d: str) -> DataFrame:
    i = geo.triangular_inverse(geo.cell())
    return _rounded(cells(spark, d), "k", ia=i[0], ib=i[1], ic=i[3], det=geo.volume(geo.cell()))


@query("SELECT s_suppkey AS k, round(a * (e * i - f * h) - b * (dd * i - f * g) + c * (dd * h - e * g), 7) AS det, round((e * i - f * h) / (a * (e * i - f * h) - b * (dd * i - f * g) + c * (dd * h - e * g)), 7) AS inv FROM (SELECT s_suppkey, 9.0::DOUBLE + s_suppkey % 5 AS a, 1.0::DOUBLE AS b, 2.0::DOUBLE AS c, 0.5::DOUBLE AS dd, 8.0::DOUBLE + s_suppkey % 3 AS e, 1.0::DOUBLE AS f, 2.0::DOUBLE AS g, 0.25::DOUBLE AS h, 7.0::DOUBLE + s_suppkey % 2 AS i FROM supplier)")
def matrix_inverse(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("s_suppkey"), F.lit
    m = ((v(9.0) + k % 5, v(1.0), v(2.0)), (v(0.5), v(8.0) + k % 3, v(1.0)), (v(2.0), v(0.25), v(7.0) + k % 2))
    det, inverse = geo.det_and_inverse(m)
    return _rounded(table(spark, d, "supplier").withColumn("k", k), "k", det=det, inv=inverse[0][0])


@query("SELECT p_partkey AS k, pow(2, ceil(ln(p_size::DOUBLE + 0.5::DOUBLE) / ln(2))) AS v FROM part")
def next_higher_power(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), geo.next_higher_power(F.col("p_size") + F.lit(0.5), 2.0).alias("v"))


#: A rotation by the quaternion (0.8, 0.6 u) about the axis u = (2, 1, 2) / 3, twice over the vector (x, y, z).
ROTATE = """q AS (SELECT particle_id AS k, x, y, z, 0.8::DOUBLE AS w, 0.4::DOUBLE AS a, 0.2::DOUBLE AS b, 0.4::DOUBLE AS c FROM p),
t AS (SELECT *, 2 * (b * z - c * y) AS tx, 2 * (c * x - a * z) AS ty, 2 * (a * y - b * x) AS tz FROM q)"""


@query(f"WITH {P}, {ROTATE} SELECT k, round(x + w * tx + (b * tz - c * ty), 7) AS x, round(y + w * ty + (c * tx - a * tz), 7) AS y, round(z + w * tz + (a * ty - b * tx), 7) AS z FROM t")
def quaternion_rotate(spark: SparkSession, d: str) -> DataFrame:
    turned = geo.quat_rotate(tuple(F.lit(v) for v in (0.8, 0.4, 0.2, 0.4)), geo.vec())  # type: ignore[arg-type]
    return _rounded(particles(spark, d).withColumn("k", F.col("particle_id")), "k", **dict(zip("xyz", turned, strict=True)))


@query(f"WITH {P} SELECT particle_id AS k, round(0.8::DOUBLE * x - 0.4::DOUBLE * y - 0.2::DOUBLE * z, 7) AS w, round(0.8::DOUBLE * y + 0.4::DOUBLE * x - 0.4::DOUBLE * z, 7) AS i FROM p")
def quaternion_multiply(spark: SparkSession, d: str) -> DataFrame:
    """The product of (0.8, 0.4, 0.2, 0.4) and (x, y, z, 0): its real and its first imaginary part."""
    q = geo.quat_multiply(tuple(F.lit(v) for v in (0.8, 0.4, 0.2, 0.4)), (F.col("x"), F.col("y"), F.col("z"), F.lit(0.0)))  # type: ignore[arg-type]
    return _rounded(particles(spark, d).withColumn("k", F.col("particle_id")), "k", w=q[0], i=q[1])


# --- neighbor lists -----------------------------------------------------------------------------------------------


@query("SELECT system_id, i, j, round(dx, 7) AS dx, round(dy, 7) AS dy, round(dz, 7) AS dz FROM (" + EDGES_SQL.replace("sx::INTEGER AS sx, sy::INTEGER AS sy, sz::INTEGER AS sz, round(r2, 9) AS r2", "dx, dy, dz") + ")")
def nl_differences(spark: SparkSession, d: str) -> DataFrame:
    """Difference vectors of the edges, from the particles and the shifts."""
    e = neighbors.neighbor_list(particles(spark, d), systems(spark, d), "cell")
    return e.select("system_id", "i", "j", *(F.round(f"d{a}", 7).alias(f"d{a}") for a in "xyz"))


# --- energies and observables -------------------------------------------------------------------------------------


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("k"), (F.lit(0.7) + 0.1 * (k % 5)).alias("ri"), (F.lit(0.8) + 0.1 * (k % 4)).alias("rj"), (F.lit(4.0) + k % 3).alias("xi"), (F.lit(5.0) + k % 6).alias("xj"))


ATOMS = "(SELECT p_partkey AS k, 0.7::DOUBLE + 0.1::DOUBLE * (p_partkey % 5) AS ri, 0.8::DOUBLE + 0.1::DOUBLE * (p_partkey % 4) AS rj, 4.0::DOUBLE + p_partkey % 3 AS xi, 5.0::DOUBLE + p_partkey % 6 AS xj FROM part)"


@query(f"SELECT k, round(ri + rj - ri * rj * (sqrt(xi) - sqrt(xj)) * (sqrt(xi) - sqrt(xj)) / (xi * ri + xj * rj), 7) AS r FROM {ATOMS}")
def uff_bond_length(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_atoms(spark, d), "k", r=energies.uff_bond_length(F.col("ri"), F.col("rj"), F.col("xi"), F.col("xj")))


@query(f"SELECT k, round(664.12::DOUBLE * xi * xj / pow(q, 2.5::DOUBLE) * ri * rj * (3 * ri * rj * (1 - c * c) - q * c), 5) AS v FROM (SELECT *, ri * ri + rj * rj - 2 * ri * rj * c AS q FROM (SELECT *, cos(1.9::DOUBLE) AS c FROM {ATOMS}))")
def uff_angle_constant(spark: SparkSession, d: str) -> DataFrame:
    return _atoms(spark, d).select("k", F.round(energies.uff_angle_constant(F.col("xi"), F.col("xj"), F.col("ri"), F.col("rj"), F.lit(1.9)), 5).alias("v"))


@query(f"SELECT k, round(sqrt(664.12::DOUBLE * xi * xj / (ri * ri * ri) / (2 * rj)), 7) AS uff, round(sqrt(xi / rj), 7) AS harmonic FROM {ATOMS}")
def morse_widths(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _rounded(_atoms(spark, d), "k", uff=energies.morse_from_uff(c("xi"), c("xj"), c("ri"), c("rj")), harmonic=energies.morse_from_harmonic(c("xi"), c("rj")))


@query("SELECT p_partkey AS k, CASE WHEN j = 3 AND l = 3 THEN round(sqrt(vj * vl), 7) WHEN j = 2 AND l = 2 THEN round(5 * sqrt(2.0::DOUBLE * 1.25::DOUBLE) * (1 + 4.18::DOUBLE * ln(1.5::DOUBLE)), 7) ELSE 1.0::DOUBLE END AS v, CASE WHEN j = 3 AND l = 3 THEN 3 WHEN j = 2 AND l = 2 THEN 2 ELSE 6 END AS n FROM (SELECT p_partkey, 2 + p_partkey % 2 AS j, 2 + p_partkey // 2 % 2 AS l, 1.0::DOUBLE + p_partkey % 3 AS vj, 2.0::DOUBLE + p_partkey % 5 AS vl FROM part)")
def uff_torsion(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = energies.uff_torsion(2 + k % 2, 2 + F.floor(k / 2) % 2, F.lit(1.0) + k % 3, F.lit(2.0) + k % 5, F.lit(2.0), F.lit(1.25), F.lit(1.5))
    return table(spark, d, "part").select(k.alias("k"), F.round(t["v"], 7).alias("v"), t["n"].alias("n"))


TERMS = "SELECT c_nationkey::BIGINT AS system_id, sum(c_custkey)::DOUBLE AS a, count(*)::DOUBLE AS b FROM customer GROUP BY 1"


@query(f"SELECT system_id, round(a - 0.5::DOUBLE * b + (a / 8) * (a / 8), 4) AS energy FROM ({TERMS})")
def energy_terms(spark: SparkSession, d: str) -> DataFrame:
    """A sum of a term, a scaled one and a mapped one."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("system_id"))
    a, b = c.agg(F.sum("c_custkey").cast("double").alias("energy")), c.agg(F.count("*").cast("double").alias("energy"))
    out = energies.summed(a, energies.scaled_energy(b, -0.5), energies.mapped(a, lambda u: (u / 8) * (u / 8)))
    return out.select("system_id", F.round("energy", 4).alias("energy"))


@query("SELECT s_suppkey AS k, round(2 * (s_suppkey % 9 + 1) / (3 * 8.0::DOUBLE) + (s_suppkey % 5 - 2) / 3.0::DOUBLE, 7) AS pressure FROM supplier")
def instantaneous_pressure(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("k"), F.round(observables.instantaneous_pressure((k % 9 + 1).cast("double"), (k % 5 - 2).cast("double"), F.lit(8.0)), 7).alias("pressure"))


RATIOS = f"SELECT s_suppkey AS system_id, ((s_suppkey % 7) - (s_suppkey % 5)) * 0.01::DOUBLE / ({BOLTZMANN!r}::DOUBLE * 300) AS boltzmann, s_suppkey % 4 AS n, 1 - 2 * (s_suppkey % 2) AS dn FROM supplier"
#: ln(V) + ln(a) for one more, and ln(n! / n'!) for at most one more or fewer; none goes where there is none.
FUGACITY = "CASE WHEN dn = 1 THEN ln(8.0::DOUBLE) - 2 - ln(n + 1.0::DOUBLE) WHEN n > 0 THEN -(ln(8.0::DOUBLE) - 2) + ln(n::DOUBLE) ELSE 0 END"


def _changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    n, dn = k % 4, 1 - 2 * (k % 2)
    s = table(spark, d, "supplier").select(k.alias("system_id"), (k % 7 * F.lit(0.01)).alias("old_energy"), (k % 5 * F.lit(0.01)).alias("new_energy"), F.lit(300.0).alias("temperature"), n.alias("n_old"), F.greatest(n + dn, F.lit(0)).alias("n_new"))
    box = s.select("system_id", *(F.lit(v).alias(c) for c, v in zip(("ax", "bx", "by", "cx", "cy", "cz"), (2.0, 0.0, 2.0, 0.0, 0.0, 2.0), strict=True)))
    return s.select("system_id", "old_energy", "new_energy", "temperature"), s.select("system_id", F.lit(0).alias("motif_id"), "n_old", "n_new", F.lit(-2.0).alias("log_fugacity")), box


@query(f"SELECT system_id, round(boltzmann, 7) AS log_ratio FROM ({RATIOS})")
def boltzmann_log_ratio(spark: SparkSession, d: str) -> DataFrame:
    return observables.boltzmann_log_ratio(_changes(spark, d)[0]).select("system_id", F.round("log_ratio", 7).alias("log_ratio"))


@query(f"SELECT system_id, round(boltzmann + {FUGACITY}, 7) AS log_ratio FROM ({RATIOS})")
def muvt_log_ratio(spark: SparkSession, d: str) -> DataFrame:
    return observables.muvt_log_ratio(*_changes(spark, d)).select("system_id", F.round("log_ratio", 7).alias("log_ratio"))


def _uniform_virial(spark: SparkSession, d: str) -> DataFrame:
    s = systems(spark, d)
    return s.select("system_id", *((F.col("system_id") * (1 + k)).cast("double").alias(f"w{a}{b}") for k, (a, b) in enumerate((a, b) for a in "xyz" for b in "xyz")))


@query(f"WITH {P} SELECT system_id, round(-system_id / 8.0::DOUBLE, 7) AS sxx, round(-system_id * 5 / 8.0::DOUBLE, 7) AS syy, round(-system_id * 9 / 8.0::DOUBLE, 7) AS szz FROM s")
def virial_stress(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(observables.virial_stress(_uniform_virial(spark, d), systems(spark, d)), "system_id", **{n: F.col(n) + 0.0 for n in ("sxx", "syy", "szz")})


@query(f"WITH {P} SELECT system_id, round(-2 * system_id / 8.0::DOUBLE, 7) AS sxx, round(-2 * (system_id + 2) / 8.0::DOUBLE, 7) AS syy FROM s")
def lattice_stress(spark: SparkSession, d: str) -> DataFrame:
    g = systems(spark, d).select("system_id", *((F.col("system_id") + k).cast("double").alias(f"g_{n}") for k, n in enumerate(("ax", "bx", "by", "cx", "cy", "cz"))))
    return _rounded(observables.lattice_stress(g, systems(spark, d)), "system_id", sxx=F.col("sxx") + 0.0, syy=F.col("syy") + 0.0)


@query(f"WITH {P} SELECT label, count(*) AS n, round(sum(mass), 5) AS mass FROM p GROUP BY 1")
def species_totals(spark: SparkSession, d: str) -> DataFrame:
    """A state property of the user's own: an aggregate by species."""
    return particles(spark, d).join(species(spark).select("label"), "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("mass"), 5).alias("mass"))


# --- Monte Carlo --------------------------------------------------------------------------------------------------


def _grand(spark: SparkSession, d: str) -> tuple[montecarlo.State, DataFrame, DataFrame]:
    """Every particle is a molecule of its own; an inserted one is one particle."""
    p = particles(spark, d).withColumn("group_id", F.col("particle_id")).withColumn("motif_id", F.lit(0)).withColumn("motif_particle_id", F.lit(0).cast("long"))
    s = systems(spark, d).withColumn("log_fugacity", F.lit(2.0))
    motif = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 1.0, 0.0, "s0")], "motif_id int, motif_particle_id long, x double, y double, z double, mass double, charge double, label string")
    return montecarlo.State(p, p.select("group_id", "system_id", "motif_id")), s, motif


@query()
def gcmc_run(spark: SparkSession, d: str) -> DataFrame:
    """A short grand-canonical chain of all systems: displacements and exchanges mixed."""
    state, s, motif = _grand(spark, d)
    par = energies.mix_lorentz_berthelot(species(spark))
    energy = lambda p: energies.lj_energy(neighbors.neighbor_list(p, s, "cell", carry=("label",)), p, par, s)
    move = montecarlo.displacement(lambda at, of, n: dynamics.translate_particle(at.particles, of, 0.1, 3, n))
    return montecarlo.run_mcmc(state, montecarlo.mixed([move, montecarlo.exchange(motif, 3)], [1, 1], 3), energy, s, 3, 3)[1]
