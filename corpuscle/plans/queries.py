"""The registered queries of the engine, and SQL for those that SQL can express.

The driver's tables stand in for simulation data: ``embeddings`` are particles (system = label, position = first three
components, box 2, cutoff 0.2), ``events`` a trajectory (system = user, step = place in time), ``orders`` and its
relatives a star of foreign keys. Doubles are rounded on both sides, well above the noise of the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BOLTZMANN, COULOMB
from ..functions import geometry as geo
from ..functions import schedules, tuning
from ..functions.special import erfc_sql
from ..operators import energies, ewald, neighbors, observables, relational, statistics
from ..sources import trajectories
from . import dynamics

BOX, CUTOFF = 2.0, 0.2
SIGMA = (0.05, 0.06, 0.07)
EPSILON = (1.0, 0.5, 0.25)
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- tables -------------------------------------------------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def particles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    xyz = [F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("particle_id"), F.col("label").cast("long").alias("system_id"), *xyz, (F.lit(1.0) + F.col("vec_id") % 3).alias("mass"), ((F.col("vec_id") % 2) * 2 - 1).cast("double").alias("charge"), F.concat(F.lit("s"), F.col("vec_id") % 3).alias("label"))


def systems(spark: SparkSession, d: str) -> DataFrame:
    one, zero = F.lit(BOX), F.lit(0.0)
    h = {"ax": one, "bx": zero, "by": one, "cx": zero, "cy": zero, "cz": one}
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("system_id")).distinct().withColumns(h | {"cutoff": F.lit(CUTOFF), "temperature": F.lit(300.0)})


def species(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"s{i}", SIGMA[i], EPSILON[i]) for i in range(3)], "label string, sigma double, epsilon double")


def series(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, d, "events").select(F.col("user_id").alias("system_id"), nth.cast("long").alias("step"), "value", "event_type")


def bonds(spark: SparkSession, d: str, n: int = 2) -> DataFrame:
    """Runs of n consecutive particles of a system: ids p0, p1, ... and positions."""
    from pyspark.sql import Window

    w = Window.partitionBy("system_id").orderBy("particle_id")
    p = particles(spark, d)
    cols = []
    for k in range(n):
        cols += [F.lead(c, k).over(w).alias(f"{c if c != 'particle_id' else 'p'}{k}") for c in ("particle_id", "x", "y", "z")]
    return p.select("system_id", *cols).where(F.col(f"p{n - 1}").isNotNull())


def between(a: int, b: int) -> tuple[Column, Column, Column]:
    """Nearest-image vector from a to b in the cubic box."""
    d = [F.col(f"{c}{b}") - F.col(f"{c}{a}") for c in "xyz"]
    return tuple(x - BOX * F.rint(x / BOX) for x in d)  # type: ignore[return-value]


P = """p AS (SELECT vec_id AS particle_id, label::BIGINT AS system_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
  1.0::DOUBLE + vec_id % 3 AS mass, ((vec_id % 2) * 2 - 1)::DOUBLE AS charge, 's' || (vec_id % 3) AS label FROM embeddings),
s AS (SELECT DISTINCT system_id FROM p)"""
SP = "sp(label, sigma, epsilon) AS (VALUES " + ", ".join(f"('s{i}', {SIGMA[i]}::DOUBLE, {EPSILON[i]}::DOUBLE)" for i in range(3)) + ")"
E0 = f"""{P},
d AS (SELECT a.system_id, a.particle_id AS i, b.particle_id AS j, a.label AS li, b.label AS lj, a.charge AS qi, b.charge AS qj,
  round_even((a.x - b.x) / {BOX}::DOUBLE, 0) AS sx, round_even((a.y - b.y) / {BOX}::DOUBLE, 0) AS sy, round_even((a.z - b.z) / {BOX}::DOUBLE, 0) AS sz,
  b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz FROM p a JOIN p b ON a.system_id = b.system_id AND a.particle_id <> b.particle_id),
v AS (SELECT *, ux + {BOX}::DOUBLE * sx AS dx, uy + {BOX}::DOUBLE * sy AS dy, uz + {BOX}::DOUBLE * sz AS dz FROM d),
e AS (SELECT * FROM (SELECT *, dx*dx + dy*dy + dz*dz AS r2 FROM v) WHERE r2 < {CUTOFF}::DOUBLE * {CUTOFF}::DOUBLE)"""
T = """t AS (SELECT user_id AS system_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value, event_type FROM events)"""


# --- relational core ----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def fk_gather(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    steps = (("o_custkey", table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey"), ("c_nationkey", table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey"), ("n_regionkey", table(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey"))
    return relational.gather_path(o, *steps).select("o_orderkey", "o_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), "n_name", "r_name")


@query("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def table_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))
    n = relational.group_count(table(spark, d, "orders"), "o_custkey", c, "c_custkey")
    return relational.join_checked(c, n, key="c_custkey")


@query("SELECT s_suppkey, total, s_acctbal FROM (SELECT s_suppkey, round(s_acctbal, 2) s_acctbal FROM supplier), (SELECT count(*) AS total FROM part)")
def broadcast(spark: SparkSession, d: str) -> DataFrame:
    return relational.broadcast_row(table(spark, d, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal")), table(spark, d, "part").agg(F.count("*").alias("total"))).select("s_suppkey", "total", "s_acctbal")


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey AS fk, 0 AS src FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderkey AS id, o_custkey AS fk, 1 AS src FROM orders WHERE o_orderstatus = 'O'),
m AS (SELECT (SELECT coalesce(max(id), -1) + 1 FROM a) AS mo, (SELECT max(c_custkey) + 1 FROM customer) AS mc)
SELECT id, fk, src FROM a UNION ALL SELECT id + mo, fk + mc, src FROM b, m""")
def union_rekey(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("cid"))
    part = lambda s, n: o.where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("fk"), F.lit(n).alias("src"))
    groups = [{"orders": part("F", 0), "customers": c}, {"orders": part("O", 1), "customers": c}]
    return relational.union_rekey(groups, {"orders": "id", "customers": "cid"}, {("orders", "fk"): "customers"})["orders"]


@query("""SELECT vec_id AS particle_id, label::BIGINT AS system_id, CASE WHEN vec_id % 5 = 0 AND label % 2 = 0 THEN -1.0::DOUBLE ELSE vec_id::DOUBLE END AS value FROM embeddings""")
def update_if(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("particle_id"), F.col("label").cast("long").alias("system_id"), F.col("vec_id").cast("double").alias("value"))
    changes = rows.where("particle_id % 5 = 0").select("particle_id", F.lit(-1.0).alias("value"))
    accept = rows.select("system_id").distinct().withColumn("accept", F.col("system_id") % 2 == 0)
    return relational.update_if(rows, "particle_id", changes, accept)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0.0::DOUBLE ELSE round(s_acctbal, 2) END AS s_acctbal FROM supplier")
def update(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"))
    return relational.update(s, "s_suppkey", s.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit(0.0).alias("s_acctbal")))


@query("""WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS nth, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
k AS (SELECT c_mktsegment, 7 * row_number() OVER (ORDER BY c_mktsegment) AS k FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT k.c_mktsegment, k.k::BIGINT AS k, r.c_custkey FROM k JOIN r ON k.c_mktsegment = r.c_mktsegment AND k.k % r.n = r.nth""")
def kth_per_key(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey")
    k = relational.arange(c.select("c_mktsegment").distinct(), ["c_mktsegment"], "n").select("c_mktsegment", (7 * (F.col("n") + 1)).cast("long").alias("k"))
    return relational.kth_per_key(c, "c_mktsegment", ["c_custkey"], k).select("c_mktsegment", "k", "c_custkey")


@query("SELECT c_mktsegment, c_custkey, pos::INTEGER AS pos FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS pos FROM customer) WHERE pos < 4")
def where_rectangular(spark: SparkSession, d: str) -> DataFrame:
    return relational.where_per_key(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", ["c_custkey"], 4).select("c_mktsegment", "c_custkey", "pos")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def where_flat(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "seg string")
    return relational.isin(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", wanted, "seg")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def group_count_dense(spark: SparkSession, d: str) -> DataFrame:
    return relational.group_count(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey")


@query("SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def group_sum_dense(spark: SparkSession, d: str) -> DataFrame:
    return relational.group_sum(table(spark, d, "orders"), "o_custkey", ["o_totalprice"], table(spark, d, "customer"), "c_custkey").select("c_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("""SELECT a.l_returnflag, b.l_linestatus, count(l.l_orderkey) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) b
LEFT JOIN lineitem l ON l.l_returnflag = a.l_returnflag AND l.l_linestatus = b.l_linestatus GROUP BY 1, 2""")
def combine_counts(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus")
    return relational.contingency(l, l.select("l_returnflag").distinct(), l.select("l_linestatus").distinct(), "l_returnflag", "l_linestatus")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def isin_semi(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return relational.isin(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", c, "c_custkey").select("o_orderkey")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def subselect_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return relational.subselect(s, table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), "nation").select("s_suppkey", "c_custkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS nth FROM orders) WHERE nth >= 10 AND nth < 5000 AND (nth - 10) % 7 = 0")
def slice_step(spark: SparkSession, d: str) -> DataFrame:
    return relational.slice_rows(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 10, 5000, 7)


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS c_nationkey FROM customer")
def apply_mask(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return relational.apply_mask(c, "c_nationkey", F.col("c_acctbal") > 0).select("c_custkey", "c_nationkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal <= 0 ORDER BY c_custkey LIMIT 5")
def select_free(spark: SparkSession, d: str) -> DataFrame:
    c = relational.apply_mask(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), "c_nationkey", F.col("c_acctbal") > 0)
    return relational.select_free(c, "c_nationkey", "c_custkey", 5).select("c_custkey")


@query("SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def encode(spark: SparkSession, d: str) -> DataFrame:
    return relational.encode(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand")[0].select("p_partkey", "p_brand", "code")


@query("SELECT o_custkey, n, (sum(n) OVER (ORDER BY o_custkey) - n)::BIGINT AS \"offset\" FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def prefix_offsets(spark: SparkSession, d: str) -> DataFrame:
    return relational.offsets(table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey")


@query("SELECT s_suppkey, round(s_acctbal * 2, 2) AS twice, round(s_acctbal + s_nationkey, 2) AS plus, floor(s_acctbal / (s_nationkey + 1))::BIGINT AS part FROM supplier")
def table_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    a, b = s.select("s_suppkey", F.col("s_acctbal").alias("v")), s.select("s_suppkey", F.col("s_nationkey").cast("double").alias("v"))
    one = relational.arithmetic(b, 1.0, "s_suppkey", "v", "+")
    parts = {"twice": relational.arithmetic(a, 2.0, "s_suppkey", "v", "*"), "plus": relational.arithmetic(a, b, "s_suppkey", "v", "+"), "part": relational.arithmetic(a, one, "s_suppkey", "v", "//")}
    out = relational.join_checked(*(t.withColumnRenamed("v", n) for n, t in parts.items()), key="s_suppkey")
    return out.select("s_suppkey", F.round("twice", 2).alias("twice"), F.round("plus", 2).alias("plus"), F.col("part").cast("long").alias("part"))


# --- neighbor lists -----------------------------------------------------------------------------------------------

EDGES_SQL = f"WITH {E0} SELECT system_id, i, j, sx::INTEGER AS sx, sy::INTEGER AS sy, sz::INTEGER AS sz, round(r2, 9) AS r2 FROM e"


def _edges(e: DataFrame) -> DataFrame:
    return e.select("system_id", "i", "j", "sx", "sy", "sz", F.round("r2", 9).alias("r2"))


@query(EDGES_SQL)
def nl_dense(spark: SparkSession, d: str) -> DataFrame:
    return _edges(neighbors.neighbor_list(particles(spark, d), systems(spark, d), "dense"))


@query(EDGES_SQL)
def nl_cell(spark: SparkSession, d: str) -> DataFrame:
    return _edges(neighbors.neighbor_list(particles(spark, d), systems(spark, d), "cell"))


@query(EDGES_SQL)
def nl_all(spark: SparkSession, d: str) -> DataFrame:
    return _edges(neighbors.neighbor_list(particles(spark, d), systems(spark, d), "all", images=False))


@query(f"WITH {E0} SELECT system_id, i, j, round(r2, 9) AS r2 FROM e WHERE r2 < 0.01::DOUBLE")
def nl_refine_cutoff(spark: SparkSession, d: str) -> DataFrame:
    e = neighbors.neighbor_list(particles(spark, d), systems(spark, d), "cell")
    return _edges(neighbors.refine_cutoff(e, systems(spark, d).withColumn("cutoff", F.lit(0.1)))).select("system_id", "i", "j", "r2")


@query(f"WITH {E0} SELECT system_id, i, j, round(r2, 9) AS r2 FROM e WHERE i % 4 = j % 4 AND i // 8 <> j // 8")
def nl_refine_mask(spark: SparkSession, d: str) -> DataFrame:
    e = neighbors.neighbor_list(particles(spark, d), systems(spark, d), "cell")
    p = particles(spark, d).withColumn("inclusion_id", F.col("particle_id") % 4).withColumn("exclusion_id", F.floor(F.col("particle_id") / 8))
    return _edges(neighbors.refine_mask(e, p)).select("system_id", "i", "j", "r2")


@query(f"WITH {P} SELECT a.system_id, a.particle_id AS i, b.particle_id AS j FROM p a JOIN p b ON a.system_id = b.system_id AND a.particle_id // 20 = b.particle_id // 20 AND a.particle_id <> b.particle_id")
def nl_all_connected(spark: SparkSession, d: str) -> DataFrame:
    p = particles(spark, d).withColumn("inclusion_id", F.floor(F.col("particle_id") / 20)).withColumn("exclusion_id", F.col("particle_id"))
    return neighbors.all_connected(p).select("system_id", "i", "j")


@query(f"""WITH {P}, o AS (SELECT unnest(range(-1, 2)) AS o),
d AS (SELECT a.system_id, a.particle_id AS i, b.particle_id AS j, a.x - b.x AS ux, a.y - b.y AS uy, a.z - b.z AS uz FROM p a JOIN p b ON a.system_id = b.system_id),
h AS (SELECT system_id, i, j, round_even(ux / 0.5::DOUBLE, 0) + oa.o AS sx, round_even(uy / 0.5::DOUBLE, 0) + ob.o AS sy, round_even(uz / 0.5::DOUBLE, 0) + oc.o AS sz, ux, uy, uz, oa.o = 0 AND ob.o = 0 AND oc.o = 0 AS near FROM d, o oa, o ob, o oc),
r AS (SELECT *, (0.5::DOUBLE * sx - ux) * (0.5::DOUBLE * sx - ux) + (0.5::DOUBLE * sy - uy) * (0.5::DOUBLE * sy - uy) + (0.5::DOUBLE * sz - uz) * (0.5::DOUBLE * sz - uz) AS r2 FROM h WHERE NOT (near AND i = j))
SELECT system_id, i, j, sx::INTEGER AS sx, sy::INTEGER AS sy, sz::INTEGER AS sz, round(r2, 9) AS r2 FROM r WHERE r2 < 0.4::DOUBLE * 0.4::DOUBLE""")
def nl_images(spark: SparkSession, d: str) -> DataFrame:
    s = systems(spark, d).withColumns({"ax": F.lit(0.5), "by": F.lit(0.5), "cz": F.lit(0.5), "cutoff": F.lit(0.4)})
    return _edges(neighbors.neighbor_list(particles(spark, d), s, "dense"))


CHANGES_SQL = EDGES_SQL.replace(f"WITH {P}", "WITH " + P.replace("embedding[1]::DOUBLE AS x", "embedding[1]::DOUBLE + CASE WHEN vec_id % 50 = 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS x"))


@query(f"SELECT system_id, i, j, sx, sy, sz, r2 FROM ({CHANGES_SQL}) EXCEPT SELECT system_id, i, j, sx, sy, sz, r2 FROM ({EDGES_SQL})")
def nl_changes(spark: SparkSession, d: str) -> DataFrame:
    p = particles(spark, d)
    moved = p.where("particle_id % 50 = 0").withColumn("x", F.col("x") + 0.1)
    added, _ = neighbors.changes(p, moved, systems(spark, d), digits=9)  # as the SQL compares
    return _edges(added)


# --- energies -----------------------------------------------------------------------------------------------------


#: Squared distances below this count as this: energies of random points would otherwise exceed what doubles can compare.
CORE = 0.0025


def soft(edges: DataFrame) -> DataFrame:
    return edges.withColumn("r2", F.greatest("r2", F.lit(CORE)))


def _lj_sum(e: str, what: str) -> str:
    return f"WITH {E0}, {SP}, q AS (SELECT e.*, (a.sigma + b.sigma) / 2 AS sg, sqrt(a.epsilon * b.epsilon) AS ep FROM e JOIN sp a ON a.label = li JOIN sp b ON b.label = lj), w AS (SELECT *, (sg*sg/r2)*(sg*sg/r2)*(sg*sg/r2) AS s6 FROM (SELECT * REPLACE (greatest(r2, {CORE}::DOUBLE) AS r2), r2 AS real_r2 FROM q)) SELECT s.system_id, {what} FROM s LEFT JOIN (SELECT system_id, count(*) AS n, {e} FROM w GROUP BY 1) g ON g.system_id = s.system_id"


@query(_lj_sum("sum(4 * ep * (s6 * s6 - s6)) / 2 AS u", "coalesce(n, 0) AS n_edges, round(coalesce(u, 0), 4) AS energy"))
def lj_energy(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: periodic neighbor join, species parameters, energy of every system."""
    p, s = particles(spark, d), systems(spark, d)
    e = soft(neighbors.neighbor_list(p, s, "cell"))
    pairs = energies.of_species(e, p, energies.mix_lorentz_berthelot(species(spark)))
    u = energies.lj(F.col("r2"), F.col("sigma"), F.col("epsilon"))
    sums = pairs.groupBy("system_id").agg(F.count("*").alias("n_edges"), (F.sum(u) / 2).alias("energy"))
    return s.select("system_id").join(sums, "system_id", "left").select("system_id", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.round(F.coalesce("energy", F.lit(0.0)), 4).alias("energy"))


@query(_lj_sum("sum(CASE WHEN r2 >= 0.04::DOUBLE THEN 0 WHEN r2 > 0.0225::DOUBLE THEN 4 * ep * (s6 * s6 - s6) * (0.04::DOUBLE - r2) * (0.04::DOUBLE - r2) * (2 * r2 + 0.04::DOUBLE - 3 * 0.0225::DOUBLE) / (0.0175::DOUBLE * 0.0175::DOUBLE * 0.0175::DOUBLE) ELSE 4 * ep * (s6 * s6 - s6) END) / 2 AS u", "round(coalesce(u, 0), 4) AS energy"))
def lj_smooth_energy(spark: SparkSession, d: str) -> DataFrame:
    p, s = particles(spark, d), systems(spark, d)
    pairs = energies.of_species(soft(neighbors.neighbor_list(p, s, "cell")), p, energies.mix_lorentz_berthelot(species(spark)))
    u = energies.lj_smooth(F.col("r2"), F.col("sigma"), F.col("epsilon"), F.lit(0.2), F.lit(0.15))
    return energies.total(pairs, u, s, half=True).select("system_id", F.round("energy", 4).alias("energy"))


def _tail_sql(expr: str, name: str) -> str:
    return f"WITH {P}, {SP}, n AS (SELECT system_id, label, count(*) AS n FROM p GROUP BY 1, 2), q AS (SELECT n1.system_id, n1.n AS ni, n2.n AS nj, (a.sigma + b.sigma) / 2 AS sg, sqrt(a.epsilon * b.epsilon) AS ep FROM n n1 JOIN n n2 ON n1.system_id = n2.system_id JOIN sp a ON a.label = n1.label JOIN sp b ON b.label = n2.label), w AS (SELECT *, pow(sg / 0.2::DOUBLE, 3) AS c FROM q) SELECT system_id, round(sum({expr}), 8) AS {name} FROM w GROUP BY 1"


@query(_tail_sql("8 * pi() / 3 * ni * nj / 8.0::DOUBLE * ep * sg * sg * sg * (c * c * c / 3 - c)", "energy"))
def lj_tail_energy(spark: SparkSession, d: str) -> DataFrame:
    u = energies.lj_tail_energy(particles(spark, d), energies.mix_lorentz_berthelot(species(spark)), systems(spark, d))
    return u.select("system_id", F.round("energy", 8).alias("energy"))


@query(_tail_sql("16 * pi() / 3 * ni * nj / 64.0::DOUBLE * ep * sg * sg * sg * (2 * c * c * c / 3 - c)", "pressure"))
def lj_tail_pressure(spark: SparkSession, d: str) -> DataFrame:
    u = energies.lj_tail_pressure(particles(spark, d), energies.mix_lorentz_berthelot(species(spark)), systems(spark, d))
    return u.select("system_id", F.round("pressure", 8).alias("pressure"))


@query(_lj_sum("sum(24 * ep * (s6 - 2 * s6 * s6) * real_r2 / r2) / 2 AS w", "round(coalesce(w, 0), 3) AS virial"))
def lj_virial(spark: SparkSession, d: str) -> DataFrame:
    p, s = particles(spark, d), systems(spark, d)
    w = energies.lj_virial(soft(neighbors.neighbor_list(p, s, "cell")), p, energies.mix_lorentz_berthelot(species(spark)), s)
    return w.select("system_id", F.round(F.col("wxx") + F.col("wyy") + F.col("wzz"), 3).alias("virial"))


@query(f"WITH {SP} SELECT a.label AS label_i, b.label AS label_j, round((a.sigma + b.sigma) / 2, 9) AS sigma, round(sqrt(a.epsilon * b.epsilon), 9) AS epsilon FROM sp a, sp b")
def lj_mixing(spark: SparkSession, d: str) -> DataFrame:
    return energies.mix_lorentz_berthelot(species(spark)).select("label_i", "label_j", F.round("sigma", 9).alias("sigma"), F.round("epsilon", 9).alias("epsilon"))


@query(f"WITH {E0} SELECT s.system_id, round(coalesce(u, 0), 5) AS energy FROM s LEFT JOIN (SELECT system_id, sum({COULOMB!r}::DOUBLE * qi * qj / sqrt(r2)) / 2 AS u FROM e GROUP BY 1) g ON g.system_id = s.system_id")
def coulomb_energy(spark: SparkSession, d: str) -> DataFrame:
    p, s = particles(spark, d), systems(spark, d)
    return energies.coulomb_energy(neighbors.neighbor_list(p, s, "cell"), p, s).select("system_id", F.round("energy", 5).alias("energy"))


def _lead(n: int) -> str:
    cols = ", ".join(f"lead({c}, {k}) OVER w AS {'p' if c == 'particle_id' else c}{k}" for k in range(n) for c in ("particle_id", "x", "y", "z"))
    vs = ", ".join(f"{c}{k + 1} - {c}{k} - 2 * round_even(({c}{k + 1} - {c}{k}) / 2.0::DOUBLE, 0) AS {'uvw'[k]}{c}" for k in range(n - 1) for c in "xyz")
    return f"b AS (SELECT system_id, {cols} FROM p WINDOW w AS (PARTITION BY system_id ORDER BY particle_id)), v AS (SELECT system_id, {vs} FROM b WHERE p{n - 1} IS NOT NULL)"


def _bonded(n: int, inner: str, value: str) -> str:
    return f"WITH {P}, {_lead(n)}{inner} SELECT system_id, round(sum({value}), 5) AS energy FROM z GROUP BY 1"


def _sum(b: DataFrame, u: Column) -> DataFrame:
    return b.groupBy("system_id").agg(F.round(F.sum(u), 5).alias("energy"))


R2 = ", z AS (SELECT system_id, sqrt(ux*ux + uy*uy + uz*uz) AS r FROM v)"


@query(_bonded(2, R2, "80 * (r - 0.2::DOUBLE) * (r - 0.2::DOUBLE)"))
def harmonic_bond(spark: SparkSession, d: str) -> DataFrame:
    return _sum(bonds(spark, d, 2), energies.harmonic_bond(geo.norm(between(0, 1)), F.lit(0.2), F.lit(80.0)))


@query(_bonded(2, R2, "3 * (1 - exp(-2 * (r - 0.2::DOUBLE))) * (1 - exp(-2 * (r - 0.2::DOUBLE)))"))
def morse_bond(spark: SparkSession, d: str) -> DataFrame:
    return _sum(bonds(spark, d, 2), energies.morse_bond(geo.norm(between(0, 1)), F.lit(0.2), F.lit(3.0), F.lit(2.0)))


A3 = ", z AS (SELECT system_id, acos(greatest(-1, least(1, -(ux*vx + uy*vy + uz*vz) / (sqrt(ux*ux + uy*uy + uz*uz) * sqrt(vx*vx + vy*vy + vz*vz))))) AS th FROM v)"


@query(_bonded(3, A3, "0.01::DOUBLE * (degrees(th) - 109.5::DOUBLE) * (degrees(th) - 109.5::DOUBLE)"))
def harmonic_angle(spark: SparkSession, d: str) -> DataFrame:
    return _sum(bonds(spark, d, 3), energies.harmonic_angle(F.degrees(energies.angle_between(between(1, 0), between(1, 2))), F.lit(109.5), F.lit(0.01)))


@query(_bonded(3, A3, "2 * ((2 * pow(cos(1.9::DOUBLE), 2) + 1) / (4 * pow(sin(1.9::DOUBLE), 2)) - 4 * cos(1.9::DOUBLE) / (4 * pow(sin(1.9::DOUBLE), 2)) * cos(th) + cos(2 * th) / (4 * pow(sin(1.9::DOUBLE), 2)))"))
def cosine_angle(spark: SparkSession, d: str) -> DataFrame:
    return _sum(bonds(spark, d, 3), energies.cosine_angle(energies.angle_between(between(1, 0), between(1, 2)), F.lit(1.9), F.lit(2.0)))


D4 = """, n AS (SELECT *, uy*vz - uz*vy AS ax, uz*vx - ux*vz AS ay, ux*vy - uy*vx AS az, vy*wz - vz*wy AS bx, vz*wx - vx*wz AS by_, vx*wy - vy*wx AS bz FROM v),
z AS (SELECT system_id, atan2(((ay*bz - az*by_) * vx + (az*bx - ax*bz) * vy + (ax*by_ - ay*bx) * vz) / sqrt(vx*vx + vy*vy + vz*vz), ax*bx + ay*by_ + az*bz) AS phi FROM n)"""


@query(_bonded(4, D4, "0.5::DOUBLE * 2 * (1 - cos(3 * pi()) * cos(3 * phi))"))
def dihedral(spark: SparkSession, d: str) -> DataFrame:
    import math

    return _sum(bonds(spark, d, 4), energies.dihedral(energies.dihedral_angle(between(0, 1), between(1, 2), between(2, 3)), F.lit(2.0), F.lit(3.0), F.lit(math.pi)))


@query(_bonded(4, ", n AS (SELECT system_id, uy*vz - uz*vy AS ax, uz*vx - ux*vz AS ay, ux*vy - uy*vx AS az, wx, wy, wz FROM v), z AS (SELECT system_id, asin(greatest(-1, least(1, (ax*wx + ay*wy + az*wz) / (sqrt(ax*ax + ay*ay + az*az) * sqrt(wx*wx + wy*wy + wz*wz))))) AS om FROM n)", "2 * (1 - cos(om))"))
def inversion(spark: SparkSession, d: str) -> DataFrame:
    om = energies.out_of_plane(between(0, 1), between(1, 2), between(2, 3))
    return _sum(bonds(spark, d, 4), energies.inversion(om, F.lit(2.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0)))


@query(f"WITH {P} SELECT s.system_id, CASE WHEN hit IS NULL THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END AS energy FROM s LEFT JOIN (SELECT DISTINCT system_id AS hit FROM p WHERE (x - 0.1::DOUBLE)*(x - 0.1::DOUBLE) + y*y + z*z < 0.0025::DOUBLE AND particle_id % 3 = 0) ON hit = system_id")
def blocking(spark: SparkSession, d: str) -> DataFrame:
    p, s = particles(spark, d).withColumn("motif_id", F.col("particle_id") % 3), systems(spark, d)
    spheres = s.select("system_id", F.lit(0).cast("long").alias("motif_id"), F.lit(0.1).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.05).alias("radius"))
    return energies.blocking_energy(p, spheres, s)


@query("SELECT c_nationkey::BIGINT AS system_id, round(sum(length(c_mktsegment) / 8.0::DOUBLE), 6) AS energy FROM customer GROUP BY 1")
def internal_energy(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("system_id"), F.col("c_mktsegment").alias("motif_id"))
    m = c.select("motif_id").distinct().withColumn("motif_energy", F.length("motif_id") / 8.0)
    return energies.internal_energy(c, m, c.select("system_id").distinct()).select("system_id", F.round("energy", 6).alias("energy"))


@query(_lj_sum("sum(4 * ep * (s6 * s6 - s6)) / 2 AS u", "round(coalesce(u, 0), 3) AS energy").replace("embedding[1]::DOUBLE AS x", "embedding[1]::DOUBLE + CASE WHEN vec_id % 50 = 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS x"))
def lj_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Energy after a change, from the cached energy and the edges that came and went."""
    p, s, par = particles(spark, d), systems(spark, d), energies.mix_lorentz_berthelot(species(spark))
    moved = p.where("particle_id % 50 = 0").withColumn("x", F.col("x") + 0.1)
    added, gone = neighbors.changes(p, moved, s)
    u = energies.updated(energies.lj_energy(soft(neighbors.neighbor_list(p, s, "cell")), p, par, s), energies.lj_energy(soft(gone), p, par, s), energies.lj_energy(soft(added), p, par, s))
    return u.select("system_id", F.round("energy", 3).alias("energy"))


# --- Ewald --------------------------------------------------------------------------------------------------------

ALPHA, KMAX = 2.5, 9.5


def _ewald_systems(spark: SparkSession, d: str) -> DataFrame:
    return systems(spark, d).withColumns({"alpha": F.lit(ALPHA), "kmax": F.lit(KMAX)})


K_SQL = f"""k AS (SELECT * FROM (SELECT x.n AS nx, y.n AS ny, z.n AS nz, pi()*pi() * (x.n*x.n + y.n*y.n + z.n*z.n) AS k2 FROM (SELECT unnest(range(0, 4)) AS n) x, (SELECT unnest(range(-3, 4)) AS n) y, (SELECT unnest(range(-3, 4)) AS n) z) WHERE k2 > 0 AND k2 <= {KMAX}::DOUBLE * {KMAX}::DOUBLE),
f AS (SELECT system_id, nx, ny, nz, k2, sum(charge * cos(pi() * nx * x + pi() * ny * y + pi() * nz * z)) AS c, sum(charge * sin(pi() * nx * x + pi() * ny * y + pi() * nz * z)) AS si FROM p, k GROUP BY ALL)"""


@query(f"WITH {P}, {K_SQL} SELECT system_id, nx::INTEGER AS nx, ny::INTEGER AS ny, nz::INTEGER AS nz, round(c, 7) + 0.0 AS s_cos, round(si, 7) + 0.0 AS s_sin FROM f")
def ewald_structure_factors(spark: SparkSession, d: str) -> DataFrame:
    f = ewald.structure_factors(particles(spark, d), ewald.k_vectors(_ewald_systems(spark, d)))
    return f.select("system_id", "nx", "ny", "nz", (F.round("s_cos", 7) + 0.0).alias("s_cos"), (F.round("s_sin", 7) + 0.0).alias("s_sin"))


@query(f"WITH {P}, {K_SQL} SELECT system_id, round(sum({COULOMB!r}::DOUBLE * (2 * pi() / 8 * exp(-k2 / (4 * {ALPHA}::DOUBLE * {ALPHA}::DOUBLE)) / k2 * CASE WHEN nx = 0 THEN 1 ELSE 2 END) * (c*c + si*si)), 5) AS energy FROM f GROUP BY 1")
def ewald_reciprocal(spark: SparkSession, d: str) -> DataFrame:
    s = _ewald_systems(spark, d)
    k = ewald.k_vectors(s)
    return ewald.reciprocal_energy(ewald.structure_factors(particles(spark, d), k), k, s).select("system_id", F.round("energy", 5).alias("energy"))


@query(f"WITH {P} SELECT system_id, round(-{COULOMB!r}::DOUBLE * {ALPHA}::DOUBLE / sqrt(pi()) * sum(charge * charge), 5) AS energy FROM p GROUP BY 1")
def ewald_self(spark: SparkSession, d: str) -> DataFrame:
    return ewald.self_energy(particles(spark, d), _ewald_systems(spark, d)).select("system_id", F.round("energy", 5).alias("energy"))


def _erfc_sum(pairs: str, less: int) -> str:
    return f"SELECT s.system_id, round(coalesce(u, 0), 5) AS energy FROM s LEFT JOIN (SELECT system_id, sum({COULOMB!r}::DOUBLE * qi * qj * (f - {less}) / sqrt(r2)) / 2 AS u FROM (SELECT *, {erfc_sql('ar')} AS f FROM (SELECT *, {ALPHA}::DOUBLE * sqrt(r2) AS ar FROM {pairs})) GROUP BY 1) g ON g.system_id = s.system_id"


@query(f"WITH {E0} " + _erfc_sum("e", 0))
def ewald_real(spark: SparkSession, d: str) -> DataFrame:
    p, s = particles(spark, d), _ewald_systems(spark, d)
    return ewald.real_energy(neighbors.neighbor_list(p, s, "cell"), p, s).select("system_id", F.round("energy", 5).alias("energy"))


@query(f"WITH {E0} " + _erfc_sum("(SELECT *, dx*dx + dy*dy + dz*dz AS r2 FROM v WHERE i // 20 = j // 20)", 1))
def ewald_exclusion(spark: SparkSession, d: str) -> DataFrame:
    p, s = particles(spark, d).withColumn("inclusion_id", F.floor(F.col("particle_id") / 20)).withColumn("exclusion_id", F.col("particle_id")), _ewald_systems(spark, d)
    return ewald.exclusion_energy(neighbors.with_vectors(neighbors.all_connected(p), p, s), p, s).select("system_id", F.round("energy", 5).alias("energy"))


@query(ORACLE_SQL["ewald_reciprocal"].replace("embedding[1]::DOUBLE AS x", "embedding[1]::DOUBLE + CASE WHEN vec_id % 50 = 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS x"))
def ewald_update(spark: SparkSession, d: str) -> DataFrame:
    p, s = particles(spark, d), _ewald_systems(spark, d)
    k, old = ewald.k_vectors(s), p.where("particle_id % 50 = 0")
    f = ewald.updated_structure_factors(ewald.structure_factors(p, k), old, old.withColumn("x", F.col("x") + 0.1), k)
    return ewald.reciprocal_energy(f, k, s).select("system_id", F.round("energy", 5).alias("energy"))


# --- observables --------------------------------------------------------------------------------------------------


@query(f"""WITH {E0}, c AS (SELECT system_id, ceil(sqrt(r2) / 0.02::DOUBLE)::BIGINT AS bin, count(*) AS n FROM e GROUP BY 1, 2), g AS (SELECT system_id, unnest(range(1, 11)) AS bin FROM s), a AS (SELECT system_id, count(*) AS n FROM p GROUP BY 1)
SELECT g.system_id, g.bin, coalesce(c.n, 0) AS n_pairs, round(coalesce(c.n, 0) * 8.0::DOUBLE / (a.n * a.n * (4 * pi() * 0.02::DOUBLE * (pow((g.bin - 0.5::DOUBLE) * 0.02::DOUBLE, 2) + 0.0004::DOUBLE / 12))), 5) AS g FROM g JOIN a USING (system_id) LEFT JOIN c ON c.system_id = g.system_id AND c.bin = g.bin""")
def rdf(spark: SparkSession, d: str) -> DataFrame:
    p, s = particles(spark, d), systems(spark, d)
    r = observables.rdf(neighbors.neighbor_list(p, s, "cell"), p, s, 0.2, 10)
    return r.select("system_id", "bin", "n_pairs", F.round("g", 5).alias("g"))


@query(f"WITH {P} SELECT system_id, round(sum((x*x + y*y + z*z) / (2 * mass)), 7) AS kinetic_energy FROM p GROUP BY 1")
def kinetic_energy(spark: SparkSession, d: str) -> DataFrame:
    p = particles(spark, d).withColumns({f"p{a}": F.col(a) for a in "xyz"})
    return observables.kinetic_energy(p, systems(spark, d)).select("system_id", F.round("kinetic_energy", 7).alias("kinetic_energy"))


@query(f"WITH {P} SELECT system_id, round(count(*) * {BOLTZMANN!r}::DOUBLE * 300 / 8, 9) AS pressure FROM p GROUP BY 1")
def ideal_gas_pressure(spark: SparkSession, d: str) -> DataFrame:
    n = relational.group_count(particles(spark, d), "system_id", systems(spark, d), "system_id")
    return observables.ideal_gas_pressure(n, systems(spark, d)).select("system_id", F.round("pressure", 9).alias("pressure"))


@query(f"""WITH {P}, q AS (SELECT *, particle_id // 50 * 100 + system_id AS group_id FROM p), f AS (SELECT group_id, min_by(x, particle_id) AS rx, min_by(y, particle_id) AS ry, min_by(z, particle_id) AS rz FROM q GROUP BY 1),
m AS (SELECT q.group_id, q.system_id, any_value(rx) AS rx, any_value(ry) AS ry, any_value(rz) AS rz, sum(mass * (x - rx)) / sum(mass) AS mx, sum(mass * (y - ry)) / sum(mass) AS my, sum(mass * (z - rz)) / sum(mass) AS mz FROM q JOIN f USING (group_id) GROUP BY 1, 2)
SELECT group_id, system_id, round(rx + mx, 8) AS comx, round(ry + my, 8) AS comy, round(rz + mz, 8) AS comz FROM m""")
def centre_of_mass(spark: SparkSession, d: str) -> DataFrame:
    p = particles(spark, d).withColumn("group_id", (F.floor(F.col("particle_id") / 50) * 100 + F.col("system_id")).cast("long"))
    return observables.centre_of_mass(p, systems(spark, d)).select("group_id", "system_id", *(F.round(f"com{a}", 8).alias(f"com{a}") for a in "xyz"))


@query("SELECT c_nationkey::BIGINT AS system_id, round(sum((5 - n) * (-3.0::DOUBLE + ln(8.0::DOUBLE)) + lgamma(n + 1.0::DOUBLE) - lgamma(6.0::DOUBLE)), 6) AS log_ratio FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def fugacity_log_ratio(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("system_id"), F.col("c_mktsegment").alias("motif_id")).agg(F.count("*").alias("n_old"))
    counts = n.select("*", F.lit(5).cast("long").alias("n_new"), F.lit(-3.0).alias("log_fugacity"))
    s = n.select("system_id").distinct().withColumns({c: F.lit(2.0 if c in ("ax", "by", "cz") else 0.0) for c in geo.CELL})
    return observables.fugacity_log_ratio(counts, s).select("system_id", F.round("log_ratio", 6).alias("log_ratio"))


@query()
def peng_robinson(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("mixture_id"), (1e4 * (F.col("s_suppkey") + 1)).alias("pressure"), F.lit(300.0).alias("temperature"))
    gas = spark.createDataFrame([("CO2", 7.3773e6, 304.13, 0.22394, 0.7), ("CH4", 4.5992e6, 190.564, 0.01142, 0.3)], "species_id string, critical_pressure double, critical_temperature double, acentric_factor double, fraction double")
    return observables.peng_robinson(s.crossJoin(F.broadcast(gas)))


# --- statistics ---------------------------------------------------------------------------------------------------

B_SQL = f"""WITH {T}, n AS (SELECT *, count(*) OVER (PARTITION BY system_id) AS k FROM t), b AS (SELECT system_id, step // (k // 10) AS block, avg(value) AS m FROM n WHERE k >= 10 AND step // (k // 10) < 10 GROUP BY 1, 2)"""


@query(B_SQL + " SELECT system_id, round(avg(m), 6) AS value_mean, round(stddev_samp(m) / sqrt(10), 6) AS value_sem FROM b GROUP BY 1")
def block_average(spark: SparkSession, d: str) -> DataFrame:
    return statistics.block_average(series(spark, d), 10, ["value"]).select("system_id", F.round("value_mean", 6).alias("value_mean"), F.round("value_sem", 6).alias("value_sem"))


@query(B_SQL + " SELECT system_id, block::BIGINT AS block, round(m, 6) AS value FROM b")
def block_means(spark: SparkSession, d: str) -> DataFrame:
    return statistics.block_means(series(spark, d), 10, ["value"]).select("system_id", F.col("block").cast("long").alias("block"), F.round("value", 6).alias("value"))


BT_SQL = f"""WITH {T}, n AS (SELECT *, count(*) OVER (PARTITION BY system_id) AS k FROM t), l AS (SELECT *, unnest([2, 4, 8, 16, 32, 64]) AS size FROM n), b AS (SELECT system_id, size, k // size AS n_blocks, step // size AS block, avg(value) AS m FROM l WHERE k // size >= 4 AND step // size < k // size GROUP BY ALL),
x AS (SELECT system_id, size, n_blocks, avg(m) AS mean, stddev_samp(m) / sqrt(count(*)) AS sem FROM b GROUP BY 1, 2, 3)"""


@query(BT_SQL + " SELECT system_id, size::BIGINT AS size, n_blocks, round(mean + 1e-8, 6) AS mean, round(sem, 6) AS sem FROM x")
def block_transform(spark: SparkSession, d: str) -> DataFrame:
    return statistics.block_transform(series(spark, d), "value").select("system_id", F.col("size").cast("long").alias("size"), "n_blocks", F.round(F.col("mean") + 1e-8, 6).alias("mean"), F.round("sem", 6).alias("sem"))


@query(BT_SQL + """, c AS (SELECT *, abs(lead(sem) OVER w - sem) / (abs(sem) + 1e-10) < 0.05 AS flat FROM x WINDOW w AS (PARTITION BY system_id ORDER BY size)), a AS (SELECT *, lag(flat) OVER (PARTITION BY system_id ORDER BY size) AS aft FROM c),
f AS (SELECT system_id, coalesce(min(CASE WHEN aft THEN size END), max(size)) AS size FROM a GROUP BY 1) SELECT x.system_id, x.size::BIGINT AS size, round(sem, 6) AS sem FROM x JOIN f ON x.system_id = f.system_id AND x.size = f.size""")
def optimal_block_average(spark: SparkSession, d: str) -> DataFrame:
    return statistics.optimal_block_average(series(spark, d), "value").select("system_id", F.col("size").cast("long").alias("size"), F.round("sem", 6).alias("sem"))


@query(f"WITH {T}, n AS (SELECT *, pow(0.9::DOUBLE, count(*) OVER (PARTITION BY system_id) - 1 - step) AS w FROM t) SELECT system_id, round(sum(w * value) / sum(w), 6) AS ema FROM n GROUP BY 1")
def ema(spark: SparkSession, d: str) -> DataFrame:
    return statistics.ema(series(spark, d), "value", 0.9).select("system_id", F.round("ema", 6).alias("ema"))


@query(f"WITH {T} SELECT system_id, round(regr_slope(value, step), 8) AS drift FROM t GROUP BY 1")
def energy_drift(spark: SparkSession, d: str) -> DataFrame:
    return statistics.drift(series(spark, d), "value").select("system_id", F.round("drift", 8).alias("drift"))


@query(f"WITH {T} SELECT system_id, step, round(sum(value) OVER (PARTITION BY system_id ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / 10, 6) AS ring_mean FROM t")
def acceptance_ring(spark: SparkSession, d: str) -> DataFrame:
    return statistics.ring_mean(series(spark, d), "value", 10).select("system_id", "step", F.round("ring_mean", 6).alias("ring_mean"))


@query(f"WITH {T}, n AS (SELECT *, count(*) OVER (PARTITION BY system_id) AS k FROM t) SELECT system_id, round(avg(value) FILTER (2 * step < k), 6) AS first_half, round(avg(value) FILTER (2 * step >= k), 6) AS last_half FROM n GROUP BY 1")
def half_means(spark: SparkSession, d: str) -> DataFrame:
    return statistics.half_means(series(spark, d), "value").select("system_id", F.round("first_half", 6).alias("first_half"), F.round("last_half", 6).alias("last_half"))


MD_SQL = f"""WITH {T}, f AS (SELECT system_id, step, value AS pe, value / 2 AS ke, 1.5::DOUBLE * value AS te, value / ({BOLTZMANN!r}::DOUBLE * 297) AS temp, value AS pr, count(*) OVER (PARTITION BY system_id) AS k FROM t),
b AS (SELECT system_id, step // (k // 10) AS block, avg(pe) AS pe, avg(te) AS te, avg(temp) AS temp, avg(pr) AS pr FROM f WHERE k >= 10 AND step // (k // 10) < 10 GROUP BY 1, 2), g AS (SELECT system_id, regr_slope(te, step) AS drift FROM f GROUP BY 1)
SELECT system_id, round(avg(pe), 6) AS potential_energy_mean, round(stddev_samp(te) / sqrt(10), 6) AS total_energy_sem, round(avg(temp), 3) AS temperature_mean, round(avg(pr), 6) AS pressure_mean, round(any_value(drift), 8) AS drift FROM b JOIN g USING (system_id) GROUP BY 1"""


@query(MD_SQL)
def md_analysis(spark: SparkSession, d: str) -> DataFrame:
    t = series(spark, d)
    v, z = F.col("value"), F.lit(0.0)
    steps = t.select("system_id", "step", v.alias("potential_energy"), (v / 2).alias("kinetic_energy"), F.array(v, z, z, z, v, z, z, z, v).alias("stress"))
    a = statistics.md_analysis(steps, t.select("system_id").distinct().withColumn("n_atoms", F.lit(100)))
    return a.select("system_id", F.round("potential_energy_mean", 6).alias("potential_energy_mean"), F.round("total_energy_sem", 6).alias("total_energy_sem"), F.round("temperature_mean", 3).alias("temperature_mean"), F.round("pressure_mean", 6).alias("pressure_mean"), F.round("drift", 8).alias("drift"))


@query(f"""WITH {T}, f AS (SELECT system_id, step, value AS u, (step % 7)::DOUBLE AS n, count(*) OVER (PARTITION BY system_id) AS k FROM t), b AS (SELECT system_id, step // (k // 5) AS block, avg(u) AS u, avg(n) AS n, avg(u * n) AS un, avg(n * n) AS nn FROM f WHERE k >= 5 AND step // (k // 5) < 5 GROUP BY 1, 2)
SELECT system_id, round(avg(n), 6) AS loading_mean, round(avg((un - u * n) / (nn - n * n) - {BOLTZMANN!r}::DOUBLE * 300), 5) AS heat_mean FROM b GROUP BY 1""")
def heat_of_adsorption(spark: SparkSession, d: str) -> DataFrame:
    t = series(spark, d)
    steps, counts = t.select("system_id", "step", F.col("value").alias("potential_energy")), t.select("system_id", "step", (F.col("step") % 7).alias("n"))
    a = statistics.mc_analysis(steps, counts, t.select("system_id").distinct().withColumn("temperature", F.lit(300.0)), 5)
    return a.select("system_id", F.round("loading_mean", 6).alias("loading_mean"), F.round("heat_mean", 5).alias("heat_mean"))


@query()
def mixture_heats(spark: SparkSession, d: str) -> DataFrame:
    t = series(spark, d)
    steps = t.select("system_id", "step", F.col("value").alias("potential_energy"))
    counts = t.select("system_id", "step", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("motif_id"), (F.col("step") % 7).alias("n")), F.struct(F.lit(1).cast("long").alias("motif_id"), (F.col("step") * F.col("step") % 5).alias("n")))).alias("c")).select("system_id", "step", "c.motif_id", "c.n")
    return statistics.mixture_heats(steps, counts, t.select("system_id").distinct().withColumn("temperature", F.lit(300.0)), 3)


@query(f"WITH {T} SELECT system_id, round(max_by(value, step), 6) AS energy, round(max_by(abs(value), step), 6) AS max_force, max(step) + 1 AS n_steps FROM t GROUP BY 1")
def relax_analysis(spark: SparkSession, d: str) -> DataFrame:
    steps = series(spark, d).select("system_id", "step", F.col("value").alias("potential_energy"), F.abs("value").alias("max_force"))
    return statistics.relax_analysis(steps).select("system_id", F.round("energy", 6).alias("energy"), F.round("max_force", 6).alias("max_force"), "n_steps")


# --- schedules, sinks ---------------------------------------------------------------------------------------------


def _schedule(spark: SparkSession, d: str, s: schedules.Schedule) -> DataFrame:
    return series(spark, d).select("step").distinct().select("step", F.round(s(F.col("step").cast("double")), 9).alias("value"))


S_SQL = "WITH " + T + ", n AS (SELECT DISTINCT step, step::DOUBLE AS s FROM t) SELECT step, round({}, 9) AS value FROM n"


@query(S_SQL.format("1 + (0.1::DOUBLE - 1) * least(1, greatest(0, s / 40))"))
def schedule_linear(spark: SparkSession, d: str) -> DataFrame:
    return _schedule(spark, d, schedules.linear(1.0, 0.1, 40))


@query(S_SQL.format("0.1::DOUBLE + 0.5::DOUBLE * (1 - 0.1::DOUBLE) * (1 + cos(pi() * least(1, greatest(0, s / 40))))"))
def schedule_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _schedule(spark, d, schedules.cosine(0.1, 1.0, 40))


@query(S_SQL.format("greatest(0.2::DOUBLE, least(1, pow(0.95::DOUBLE, s)))"))
def schedule_exponential(spark: SparkSession, d: str) -> DataFrame:
    return _schedule(spark, d, schedules.exponential(1.0, 0.95, 0.2, 1.0))


@query(S_SQL.format("CASE WHEN s >= 30 THEN 3.0::DOUBLE WHEN s >= 10 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"))
def schedule_steps(spark: SparkSession, d: str) -> DataFrame:
    return _schedule(spark, d, schedules.steps([0, 10, 30], [1.0, 2.0, 3.0]))


@query(S_SQL.format("CASE WHEN s < 20 THEN 1 + (0.5::DOUBLE - 1) * least(1, greatest(0, s / 20)) ELSE 0.5::DOUBLE END"))
def schedule_composed(spark: SparkSession, d: str) -> DataFrame:
    return _schedule(spark, d, schedules.composed(schedules.linear(1.0, 0.5, 20), schedules.constant(0.5), 20))


@query()
def acceptance_tuning(spark: SparkSession, d: str) -> DataFrame:
    return tuning.tuned(series(spark, d).withColumn("acceptance", (F.col("value") > 20).cast("double")), 20)


@query(f"WITH {T} SELECT system_id, step, step // 10 AS slot, round(value, 6) AS value FROM t WHERE step % 10 = 0")
def log_every_n(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.every(series(spark, d), 10).select("system_id", "step", "slot", F.round("value", 6).alias("value"))


@query(f"WITH {T} SELECT system_id, step, round(value, 6) AS value FROM t WHERE step = 0")
def log_once(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.once(series(spark, d)).select("system_id", "step", F.round("value", 6).alias("value"))


# --- geometry -----------------------------------------------------------------------------------------------------


@query(f"""WITH {P}, f AS (SELECT particle_id, z / 0.45::DOUBLE AS fc, x, y FROM p), g AS (SELECT particle_id, fc, (y - fc * 0.05::DOUBLE) / 0.5::DOUBLE AS fb, x FROM f), h AS (SELECT particle_id, fc, fb, (x - fb * 0.1::DOUBLE - fc * 0.2::DOUBLE) / 0.6::DOUBLE AS fa FROM g),
w AS (SELECT particle_id, fa + 0.5::DOUBLE - floor(fa + 0.5::DOUBLE) - 0.5::DOUBLE AS a, fb + 0.5::DOUBLE - floor(fb + 0.5::DOUBLE) - 0.5::DOUBLE AS b, fc + 0.5::DOUBLE - floor(fc + 0.5::DOUBLE) - 0.5::DOUBLE AS c FROM h)
SELECT particle_id, round(a * 0.6::DOUBLE + b * 0.1::DOUBLE + c * 0.2::DOUBLE, 7) AS x, round(b * 0.5::DOUBLE + c * 0.05::DOUBLE, 7) AS y, round(c * 0.45::DOUBLE, 7) AS z FROM w""")
def wrap_triclinic(spark: SparkSession, d: str) -> DataFrame:
    h = tuple(F.lit(v) for v in (0.6, 0.1, 0.5, 0.2, 0.05, 0.45))
    return particles(spark, d).select("particle_id", *(F.round(c, 7).alias(a) for c, a in zip(geo.wrap(geo.vec(), h), "xyz", strict=True)))


@query(f"WITH {P} SELECT system_id, particle_id * 8 + k AS particle_id, round(x + 2 * (k % 2), 7) AS x, round(y + 2 * (k // 2 % 2), 7) AS y, round(z + 2 * (k // 4), 7) AS z FROM p, (SELECT unnest(range(0, 8)) AS k)")
def supercell(spark: SparkSession, d: str) -> DataFrame:
    p, _ = neighbors.supercell(particles(spark, d), systems(spark, d), 2, 2, 2)
    return p.select("system_id", "particle_id", *(F.round(a, 7).alias(a) for a in "xyz"))


# --- steppers -----------------------------------------------------------------------------------------------------


def _moving(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = particles(spark, d).withColumns({f"p{a}": F.col(a) for a in "xyz"} | {f"g{a}": -F.col(a) for a in "xyz"})
    return p, systems(spark, d).withColumns({"time_step": F.lit(0.5), "friction_coefficient": F.lit(0.1), "thermostat_time_constant": F.lit(10.0)})


@query(f"WITH {P} SELECT particle_id, round(x * 1.25::DOUBLE, 7) AS px, round(y * 1.25::DOUBLE, 7) AS py, round(z * 1.25::DOUBLE, 7) AS pz FROM p")
def md_momentum_step(spark: SparkSession, d: str) -> DataFrame:
    p = dynamics.momentum_step(*_moving(spark, d))
    return p.select("particle_id", *(F.round(f"p{a}", 7).alias(f"p{a}") for a in "xyz"))


@query(f"WITH {P}, m AS (SELECT particle_id, (x + x / mass * 0.5::DOUBLE) / 2 AS a, (y + y / mass * 0.5::DOUBLE) / 2 AS b, (z + z / mass * 0.5::DOUBLE) / 2 AS c FROM p) SELECT particle_id, " + ", ".join(f"round(2 * ({f} + 0.5::DOUBLE - floor({f} + 0.5::DOUBLE) - 0.5::DOUBLE), 7) AS {a}" for f, a in zip("abc", "xyz", strict=True)) + " FROM m")
def md_position_step(spark: SparkSession, d: str) -> DataFrame:
    p = dynamics.position_step(*_moving(spark, d))
    return p.select("particle_id", *(F.round(a, 7).alias(a) for a in "xyz"))


@query()
def md_langevin_step(spark: SparkSession, d: str) -> DataFrame:
    return dynamics.langevin_step(*_moving(spark, d), 1, 0).select("particle_id", "system_id", "px", "py", "pz")


@query()
def md_rescaling_thermostat(spark: SparkSession, d: str) -> DataFrame:
    return dynamics.rescaling_thermostat(*_moving(spark, d), 1, 0).select("particle_id", "system_id", "px", "py", "pz")


@query()
def md_run(spark: SparkSession, d: str) -> DataFrame:
    p, s = _moving(spark, d)
    return dynamics.run_md(p, s.withColumn("time_step", F.lit(1e-4)), 5, 0.02, 1e-6, CUTOFF)


@query()
def mc_particle_translation(spark: SparkSession, d: str) -> DataFrame:
    return dynamics.translate_particle(particles(spark, d), systems(spark, d), 0.1, 1, 0).select("particle_id", "system_id", "x", "y", "z")


@query()
def mc_group_moves(spark: SparkSession, d: str) -> DataFrame:
    p = particles(spark, d).withColumn("group_id", (F.floor(F.col("particle_id") / 50) * 100 + F.col("system_id")).cast("long"))
    g = p.select("group_id", "system_id").distinct()
    kinds = {"translation": {"translation": 0.1}, "rotation": {"rotation": 0.5}, "reinsertion": {"anywhere": True}}
    moved = [dynamics.move_group(p, g, systems(spark, d), 1, n, **k).select(F.lit(name).alias("move"), "particle_id", "system_id", "group_id", "x", "y", "z") for n, (name, k) in enumerate(kinds.items())]
    return moved[0].union(moved[1]).union(moved[2])


@query()
def mc_accept(spark: SparkSession, d: str) -> DataFrame:
    e = systems(spark, d).select("system_id", F.lit(0.0).alias("old_energy"), (F.col("system_id") * 0.01).alias("new_energy"), "temperature")
    return dynamics.accept(observables.boltzmann_log_ratio(e), 1, 0)


@query()
def relax_run(spark: SparkSession, d: str) -> DataFrame:
    p = particles(spark, d)
    return dynamics.run_relax(p, systems(spark, d), 5, 0.02, 1e-6, CUTOFF, "fire")


from . import function_queries  # noqa: E402, F401  registers more queries
