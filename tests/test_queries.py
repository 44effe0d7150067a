"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import math

import pytest

from corpuscle.plans.queries import ORACLE_SQL, QUERIES

from .conftest import DATA


def _sorted(rows):
    clean = lambda v: "null" if v is None else "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(clean, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in ORACLE_SQL:
        assert rows or name == "mc_accept"
        return
    own = duck.sql(ORACLE_SQL[name])
    assert sorted(own.columns) == columns
    expected = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert _sorted(rows) == _sorted(expected)


def test_whole_tables_are_answered(spark):
    ids = lambda table, key: {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()}
    of = lambda name, key: {r[0] for r in QUERIES[name](spark, DATA).select(key).distinct().collect()}
    assert of("nl_images", "i") == ids("embeddings", "vec_id")
    nations = {r[0] for r in spark.read.parquet(f"{DATA}/customer.parquet").select("c_nationkey").collect()}
    with_customers = {r[0] for r in spark.read.parquet(f"{DATA}/supplier.parquet").select("s_suppkey", "s_nationkey").collect() if r[1] in nations}
    assert of("subselect_pairs", "s_suppkey") == with_customers and "< 60" not in ORACLE_SQL["nl_images"] and "<= 10" not in ORACLE_SQL["subselect_pairs"]


def test_particles_moved_alike_keep_their_edges(spark, tmp_path):
    import duckdb

    rows = duckdb.sql(f"SELECT vec_id * 50 AS vec_id, label % 2 AS label, embedding FROM '{DATA}/embeddings.parquet'")  # every one is moved
    rows.write_parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    columns = "system_id, i, j, sx, sy, sz, r2".split(", ")
    expected = c.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['nl_changes']})").fetchall()
    assert _sorted(map(tuple, QUERIES["nl_changes"](spark, str(tmp_path)).select(*columns).collect())) == _sorted(expected)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10


def test_edges_that_carry_labels_give_the_energy_without_a_join_of_edges(spark):
    from corpuscle.operators import energies, neighbors
    from corpuscle.plans import queries

    p, s, par = queries.particles(spark, DATA), queries.systems(spark, DATA), energies.mix_lorentz_berthelot(queries.species(spark))
    energy = lambda **k: energies.lj_energy(neighbors.neighbor_list(p, s, "cell", **k), p, par, s)
    carried, joined = energy(carry=("label",)), energy()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(carried).count("Join") == plan(joined).count("Join") - 2
    old = {r.system_id: r.energy for r in joined.collect()}
    assert {r.system_id: r.energy for r in carried.collect()} == pytest.approx(old, rel=1e-9)
