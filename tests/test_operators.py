"""Small cases with known results, invariants, and operators against other routes to the same result."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.constants import BOLTZMANN, COULOMB
from corpuscle.functions import geometry as geo
from corpuscle.functions import tuning
from corpuscle.operators import energies, ewald, neighbors, observables, relational, statistics
from corpuscle.plans import dynamics
from corpuscle.sources import structures, trajectories
from corpuscle.streaming import trajectories as streams


def cube(spark, length, cutoff, n=1, **more):
    rows = [(i, length, 0.0, length, 0.0, 0.0, length, cutoff) for i in range(n)]
    return spark.createDataFrame(rows, "system_id long, ax double, bx double, by double, cx double, cy double, cz double, cutoff double").withColumns({k: F.lit(v) for k, v in more.items()})


def atoms(spark, xyz, system=None):
    rows = [(i, (system or [0] * len(xyz))[i], *map(float, p)) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "particle_id long, system_id long, x double, y double, z double")


def pairs(edges):
    return sorted((r.i, r.j) for r in edges.collect())


# --- relational ---------------------------------------------------------------------------------------------------


def test_group_sum_keeps_empty_keys(spark):
    rows = spark.createDataFrame([(0, 1), (1, 2), (0, 3), (1, 4), (None, 9)], "k long, v long")
    keys = spark.createDataFrame([(0,), (1,), (2,)], "key long")
    assert {r.key: r.v for r in relational.group_sum(rows, "k", ["v"], keys, "key").collect()} == {0: 4, 1: 6, 2: 0}


def test_kth_per_key_wraps_and_misses(spark):
    rows = spark.createDataFrame([("A", 0), ("A", 1), ("A", 2)], "key string, pos long")
    k = spark.createDataFrame([("A", 5), ("B", 0)], "key string, k long")
    assert {r.key: r.pos for r in relational.kth_per_key(rows, "key", ["pos"], k).collect()} == {"A": 2, "B": None}


def test_where_per_key(spark):
    rows = spark.createDataFrame(list(zip("HOHOH", range(5), strict=True)), "key string, at long")
    got = relational.where_per_key(rows, "key", ["at"], 3).collect()
    assert sorted((r.key, r.pos, r["at"]) for r in got) == [("H", 0, 0), ("H", 1, 2), ("H", 2, 4), ("O", 0, 1), ("O", 1, 3)]


def test_join_checked_refuses_other_keys(spark):
    a, b = spark.createDataFrame([(0, 1)], "k long, a long"), spark.createDataFrame([(1, 1)], "k long, b long")
    with pytest.raises(ValueError, match="key sets differ"):
        relational.join_checked(a, b, key="k")


def test_update_if_by_old_and_new_owner(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0), (2, 0, 3.0)], "id long, system_id long, v double")
    changes = spark.createDataFrame([(0, 0, 90.0), (1, 1, 91.0), (2, None, 92.0)], "id long, system_id long, v double")
    accept = spark.createDataFrame([(0, True), (1, False)], "system_id long, accept boolean")
    got = {r.id: (r.system_id, r.v) for r in relational.update_if(rows, "id", changes, accept).collect()}
    assert got == {0: (0, 90.0), 1: (1, 2.0), 2: (None, 92.0)}


def test_union_rekeys_and_shifts_references(spark):
    one = {"t": spark.createDataFrame([(0, 1), (1, 2)], "id long, v long"), "c": spark.createDataFrame([(0, 1)], "cid long, t long")}
    two = {"t": spark.createDataFrame([(0, 3), (1, 4), (2, 5)], "id long, v long"), "c": spark.createDataFrame([(0, 2), (1, None)], "cid long, t long")}
    out = relational.union_rekey([one, two], {"t": "id", "c": "cid"}, {("c", "t"): "t"})
    assert sorted(map(tuple, out["t"].collect())) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    assert sorted(map(tuple, out["c"].collect()), key=str) == [(0, 1), (1, 4), (2, None)]


def test_arange_lookup_and_errors(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",)], "w string")
    assert {r.w: r.key for r in relational.arange(rows, ["w"]).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError, match="repeated keys"):
        relational.assert_unique(rows.union(rows), "w")
    _, words = relational.encode(rows, "w")
    with pytest.raises(KeyError):
        relational.lookup(spark.createDataFrame([("z",)], "w string"), "w", words.withColumnRenamed("w", "word"), "word")


# --- neighbors ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("strategy", ["all", "dense", "cell"])
class TestNeighbors:
    def test_chain(self, spark, strategy):
        e = neighbors.neighbor_list(atoms(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)]), cube(spark, 10.0, 1.5), strategy)
        assert pairs(e) == [(0, 1), (1, 0), (1, 2), (2, 1)]

    def test_cutoff_is_strict(self, spark, strategy):
        assert pairs(neighbors.neighbor_list(atoms(spark, [(0, 0, 0), (1, 0, 0)]), cube(spark, 10.0, 1.0), strategy)) == []

    def test_periodic(self, spark, strategy):
        e = neighbors.neighbor_list(atoms(spark, [(0.1, 0, 0), (2.9, 0, 0)]), cube(spark, 3.0, 1.0), strategy)
        assert pairs(e) == [(0, 1), (1, 0)] and {round(r.r2, 9) for r in e.collect()} == {0.04}

    def test_systems_are_apart(self, spark, strategy):
        p = atoms(spark, [(0, 0, 0), (1, 0, 0), (0, 0, 0), (1, 0, 0)], [0, 0, 1, 1])
        assert pairs(neighbors.neighbor_list(p, cube(spark, 10.0, 1.5, 2), strategy)) == [(0, 1), (1, 0), (2, 3), (3, 2)]

    def test_exclusion_suppresses_the_nearest_image_only(self, spark, strategy):
        p = atoms(spark, [(0.1, 0.1, 0.1), (0.4, 0.1, 0.1)])
        s = cube(spark, 0.5, 0.4)
        of = lambda e: sorted((r.i, r.j, r.sx) for r in e.where("i <> j and sy = 0 and sz = 0").collect())
        both = of(neighbors.neighbor_list(p, s, strategy))
        assert (0, 1, -1) in both and (1, 0, 1) in both
        shared = of(neighbors.neighbor_list(p.withColumn("exclusion_id", F.lit(7)), s, strategy))
        assert (0, 1, -1) not in shared and (0, 1, 0) in shared and (1, 0, 0) in shared

    def test_triclinic_against_numpy(self, spark, strategy):
        rng = np.random.default_rng(3)
        h = np.array([[5.0, 0, 0], [1.2, 4.5, 0], [-0.7, 0.9, 4.0]])
        x = rng.random((40, 3)) @ h
        s = spark.createDataFrame([(0, 5.0, 1.2, 4.5, -0.7, 0.9, 4.0, 1.3)], "system_id long, ax double, bx double, by double, cx double, cy double, cz double, cutoff double")
        d = (x[None] - x[:, None]) @ np.linalg.inv(h)
        r = np.linalg.norm((d - np.rint(d)) @ h, axis=-1)
        assert pairs(neighbors.neighbor_list(atoms(spark, x), s, strategy)) == sorted((i, j) for i in range(40) for j in range(40) if i != j and r[i, j] < 1.3)

    def test_empty(self, spark, strategy):
        assert neighbors.neighbor_list(atoms(spark, [(0, 0, 0)]).limit(0), cube(spark, 3.0, 1.0), strategy).count() == 0


# --- energies -----------------------------------------------------------------------------------------------------


def test_mixing_and_bond_numbers(spark):
    mixed = energies.mix_lorentz_berthelot(spark.createDataFrame([("a", 2.8, 27.0), ("b", 3.05, 79.0), ("c", None, None)], "label string, sigma double, epsilon double"))
    got = {(r.label_i, r.label_j): (r.sigma, r.epsilon) for r in mixed.collect()}
    assert got["a", "b"] == (pytest.approx(2.925), pytest.approx(46.18441296)) and got["c", "c"] == (1.0, 0.0)
    assert spark.range(1).select(energies.harmonic_bond(F.lit(1.0), F.lit(1.2), F.lit(80.0))).first()[0] == pytest.approx(3.2)
    s6 = 1.2**6
    assert spark.range(1).select(energies.lj(F.lit(1.0), F.lit(1.2), F.lit(0.8))).first()[0] == pytest.approx(4 * 0.8 * (s6 * s6 - s6))


def test_coulomb_pairs(spark):
    p = atoms(spark, [(0, 0, 0), (1, 0, 0), (5, 0, 0), (6, 0, 0)]).withColumn("charge", F.when(F.col("particle_id") % 2 == 0, 1.0).otherwise(-1.0))
    e = neighbors.neighbor_list(p, cube(spark, 20.0, 1.5), "dense")
    assert energies.coulomb_energy(e, p, cube(spark, 20.0, 1.5)).first().energy == pytest.approx(-2 * COULOMB)


def test_forces_are_minus_the_gradient(spark):
    rng = np.random.default_rng(5)
    x = rng.random((12, 3)) * 3
    s = cube(spark, 3.0, 1.4)
    par = spark.createDataFrame([("s", "s", 0.6, 0.3)], "label_i string, label_j string, sigma double, epsilon double")

    def energy(y):
        p = atoms(spark, y).withColumn("label", F.lit("s"))
        return energies.lj_energy(neighbors.neighbor_list(p, s, "dense", images=False), p, par, s).first().energy, p

    _, p = energy(x)
    f = {r.particle_id: (r.fx, r.fy, r.fz) for r in energies.lj_forces(neighbors.neighbor_list(p, s, "dense", images=False), p, par).collect()}
    h = 1e-6
    for axis in range(3):
        up, down = x.copy(), x.copy()
        up[4, axis] += h
        down[4, axis] -= h
        assert f[4][axis] == pytest.approx(-(energy(up)[0] - energy(down)[0]) / (2 * h), rel=1e-4)
    assert np.abs(np.sum(list(f.values()), axis=0)).max() < 1e-6 * max(1.0, np.abs(list(f.values())).max())


def test_changes_equal_full_lists(spark):
    rng = np.random.default_rng(7)
    p, s = atoms(spark, rng.random((60, 3)) * 4), cube(spark, 4.0, 1.0)
    moved = p.where("particle_id % 9 = 0").withColumn("x", F.col("x") + 0.7)
    added, gone = neighbors.changes(p, moved, s)
    full = relational.update(p, "particle_id", moved)
    before, after = (set(pairs(neighbors.neighbor_list(t, s, "cell"))) for t in (p, full))
    at = lambda e: {(r.i, r.j, round(r.r2, 9)) for r in e.collect()}
    old, new = at(neighbors.neighbor_list(p, s, "dense")), at(neighbors.neighbor_list(full, s, "dense"))
    assert at(added) == new - old and at(gone) == old - new and before != after


def test_changes_of_a_small_cell_have_further_images(spark):
    rng = np.random.default_rng(8)
    p, s = atoms(spark, rng.random((12, 3))), cube(spark, 1.0, 0.8)
    moved = p.where("particle_id % 5 = 0").withColumn("x", F.col("x") + 0.13)
    at = lambda e: {(r.i, r.j, r.sx, r.sy, r.sz, round(r.r2, 9)) for r in e.collect()}
    added, gone = map(at, neighbors.changes(p, moved, s))
    old, new = (at(neighbors.neighbor_list(t, s, "dense")) for t in (p, relational.update(p, "particle_id", moved)))
    assert gone <= old and added <= new and (old - gone) | added == new and any(i == 0 and abs(x) + abs(y) + abs(z) > 1 for i, _, x, y, z, _ in added)


def test_ewald_does_not_depend_on_alpha(spark):
    rng = np.random.default_rng(11)
    p = atoms(spark, rng.random((8, 3)) * 4).withColumn("charge", F.when(F.col("particle_id") % 2 == 0, 1.0).otherwise(-1.0))
    totals = []
    for alpha in (1.3, 1.7):
        s = cube(spark, 4.0, 4.0, alpha=alpha, kmax=2 * alpha * 4.6)
        k = ewald.k_vectors(s)
        parts = [ewald.real_energy(neighbors.neighbor_list(p, s, "dense"), p, s), ewald.reciprocal_energy(ewald.structure_factors(p, k), k, s), ewald.self_energy(p, s)]
        totals.append(energies.summed(*parts).first().energy)
    assert totals[0] == pytest.approx(totals[1], rel=1e-5)


def test_structure_factor_update_equals_recompute(spark):
    rng = np.random.default_rng(13)
    p, s = atoms(spark, rng.random((10, 3)) * 4).withColumn("charge", F.lit(1.0)), cube(spark, 4.0, 1.0, alpha=1.0, kmax=4.0)
    k, old = ewald.k_vectors(s), p.where("particle_id = 3")
    new = old.withColumn("y", F.col("y") + 0.5)
    a = ewald.updated_structure_factors(ewald.structure_factors(p, k), old, new, k)
    b = ewald.structure_factors(relational.update(p, "particle_id", new), k)
    at = lambda f: {(r.nx, r.ny, r.nz): (r.s_cos, r.s_sin) for r in f.collect()}
    x, y = at(a), at(b)
    assert x.keys() == y.keys() and all(x[q] == pytest.approx(y[q], abs=1e-9) for q in x)


def test_estimated_ewald_parameters():
    alpha, kmax = ewald.estimate_parameters(10.0, 1e-6)
    assert math.erfc(alpha * 10.0) == pytest.approx(5e-6, rel=1e-6) and kmax > 0


# --- observables, statistics ---------------------------------------------------------------------------------------


def test_rdf_is_dense(spark):
    p, s = atoms(spark, [(0, 0, 0)]), cube(spark, 20.0, 5.0)
    r = observables.rdf(neighbors.neighbor_list(p, s, "dense"), p, s, 5.0, 50).collect()
    assert len(r) == 50 and all(x.g == 0 for x in r)


def test_equation_of_state_at_low_pressure(spark):
    g = spark.createDataFrame([(0, "a", 1.0, 300.0, 7.3773e6, 304.13, 0.22394, 1.0)], "mixture_id long, species_id string, pressure double, temperature double, critical_pressure double, critical_temperature double, acentric_factor double, fraction double")
    r = observables.peng_robinson(g).first()
    assert r.compressibility == pytest.approx(1, abs=1e-4) and r.log_fugacity == pytest.approx(0.0, abs=1e-4)


def test_cubic_roots(spark):
    high, low = geo.largest_and_smallest_cubic_root(F.lit(-6.0), F.lit(11.0), F.lit(-6.0))
    assert list(spark.range(1).select(high, low).first()) == pytest.approx([3.0, 1.0])
    one, same = geo.largest_and_smallest_cubic_root(F.lit(0.0), F.lit(0.0), F.lit(-8.0))
    assert list(spark.range(1).select(one, same).first()) == pytest.approx([2.0, 2.0])


def test_centre_of_mass_across_the_boundary(spark):
    p = atoms(spark, [(0.1, 0, 0), (2.9, 0, 0)]).withColumns({"group_id": F.lit(5).cast("long"), "mass": F.lit(1.0)})
    s = cube(spark, 3.0, 1.0)
    c = observables.centre_of_mass(p, s)
    assert c.first().comx == pytest.approx(0.0, abs=1e-9)
    rel = observables.relative_positions(p, c, s)
    assert sorted(round(r.x, 9) for r in rel.collect()) == [-0.1, 0.1]
    back = observables.absolute_positions(rel, c, s)
    assert sorted(round(r.x, 9) for r in back.collect()) == [-0.1, 0.1]


def test_block_average_drops_what_does_not_fill_a_block(spark):
    t = spark.range(105).select(F.lit(0).cast("long").alias("system_id"), F.col("id").alias("step"), F.col("id").cast("double").alias("v"))
    assert statistics.block_average(t, 10, ["v"]).first().v_mean == pytest.approx(49.5)


def test_ring_mean_starts_with_zeros(spark):
    t = spark.range(4).select(F.lit(0).cast("long").alias("system_id"), F.col("id").alias("step"), F.lit(1.0).alias("v"))
    assert [r.ring_mean for r in statistics.ring_mean(t, "v", 4).orderBy("step").collect()] == [0.25, 0.5, 0.75, 1.0]


def test_constant_series_have_no_heat(spark):
    t = spark.range(20).select(F.lit(0).cast("long").alias("system_id"), F.col("id").alias("step"), F.lit(1.0).alias("potential_energy"))
    r = statistics.mc_analysis(t, t.select("system_id", "step", F.lit(3).alias("n")), spark.createDataFrame([(0, 300.0)], "system_id long, temperature double"), 4).first()
    assert r.loading_mean == 3 and r.heat_mean is None


def test_quaternions(spark):
    q = geo.quat_random(F.lit(0.3), F.lit(0.6), F.lit(0.9))
    v = geo.quat_rotate(q, (F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    back = geo.quat_rotate(geo.quat_inverse(q), v)
    assert spark.range(1).select(geo.dot(v, v)).first()[0] == pytest.approx(14.0)
    assert list(spark.range(1).select(*back).first()) == pytest.approx([1.0, 2.0, 3.0])
    half = geo.quat_power(q, 0.5)
    whole = geo.quat_multiply(half, half)
    a, b = spark.range(1).select(*whole).first(), spark.range(1).select(*q).first()
    assert list(a) == pytest.approx(list(b)) or list(a) == pytest.approx([-x for x in b])


def test_matrices(spark):
    m = [[F.lit(float(v)) for v in row] for row in ((2, 1, 0), (0, 3, 1), (1, 0, 4))]
    det, inv = geo.det_and_inverse(m)
    got = spark.range(1).select(det, *(c for row in inv for c in row)).first()
    a = np.array([[2, 1, 0], [0, 3, 1], [1, 0, 4]], float)
    assert got[0] == pytest.approx(np.linalg.det(a)) and list(got[1:]) == pytest.approx(np.linalg.inv(a).ravel().tolist())
    low, turn = geo.to_lower_triangular([[1, 1, 0], [0, 2, 1], [1, 0, 3]])
    h = np.array([[low[0], 0, 0], [low[1], low[2], 0], [low[3], low[4], low[5]]])
    assert np.allclose(h @ h.T, np.array([[1, 1, 0], [0, 2, 1], [1, 0, 3]]) @ np.array([[1, 1, 0], [0, 2, 1], [1, 0, 3]]).T) and np.allclose(np.array(turn).T @ np.array(turn), np.eye(3))


# --- dynamics -----------------------------------------------------------------------------------------------------


def _lattice(spark, n=3, spacing=1.2):
    x = np.array([(i, j, k) for i in range(n) for j in range(n) for k in range(n)], float) * spacing
    p = atoms(spark, x).withColumn("mass", F.lit(1.0))
    return p, cube(spark, n * spacing, 1.5, temperature=50.0, time_step=0.002, friction_coefficient=1.0, thermostat_time_constant=0.1)


def test_verlet_keeps_the_energy(spark):
    p, s = _lattice(spark)
    p = dynamics.maxwell_boltzmann(p, s, 4)
    assert abs(p.agg(F.sum("px")).first()[0]) < 1e-9
    run = dynamics.run_md(p, s, 200, 1.0, 0.01, 1.5, "verlet").select((F.col("potential_energy") + F.col("kinetic_energy")).alias("e")).collect()
    e = [r.e for r in run]
    assert max(e) - min(e) < 0.05 * abs(np.mean([abs(x) for x in e]))


@pytest.mark.parametrize("integrator", ["baoab_langevin", "csvr"])
def test_thermostats_reach_the_temperature(spark, integrator):
    p, s = _lattice(spark)
    p = dynamics.maxwell_boltzmann(p, s, 4)
    run = dynamics.run_md(p, s.withColumn("time_step", F.lit(0.05)), 1500, 1.0, 1e-4, 1.5, integrator, seed=1)
    t = run.where("step > 300").agg(F.avg("kinetic_energy")).first()[0] * 2 / (BOLTZMANN * (3 * 27 - 3))
    assert t == pytest.approx(50.0, rel=0.15)


@pytest.mark.parametrize("optimizer", ["fire", "lbfgs"])
def test_relaxation_lowers_force(spark, optimizer):
    p, s = _lattice(spark)
    p = p.withColumn("x", F.col("x") + 0.05 * F.sin(F.col("particle_id").cast("double")))
    steps = statistics.relax_analysis(dynamics.run_relax(p, s, 120, 1.0, 0.5, 1.5, optimizer, 1e-3)).first()
    assert steps.max_force < 0.2


def test_moves_keep_molecules_rigid(spark):
    p = atoms(spark, [(0, 0, 0), (0.5, 0, 0), (0, 0.5, 0), (2, 2, 2), (2.5, 2, 2)]).withColumns({"group_id": F.when(F.col("particle_id") < 3, 0).otherwise(1).cast("long"), "mass": F.lit(1.0)})
    s = cube(spark, 6.0, 1.0)
    g = p.select("group_id", "system_id").distinct()
    for kind in ({"translation": 0.4}, {"rotation": 0.7}, {"anywhere": True}):
        before, after = ({r.particle_id: np.array([r.x, r.y, r.z]) for r in t.collect()} for t in (p, dynamics.move_group(p, g, s, 3, 1, **kind)))
        ids = sorted(after)
        dist = lambda a, b, t: np.linalg.norm((t[a] - t[b]) - 6 * np.rint((t[a] - t[b]) / 6))
        assert len({int(i > 2) for i in ids}) == 1
        assert all(dist(a, b, before) == pytest.approx(dist(a, b, after)) for a in ids for b in ids)


def test_insert_and_delete(spark):
    s = cube(spark, 6.0, 1.0, 2)
    m = structures.motifs(spark, {0: structures.CARBON_DIOXIDE})
    p = spark.createDataFrame([], "particle_id long, system_id long, x double, y double, z double, mass double, charge double, label string, group_id long, motif_particle_id long")
    g = spark.createDataFrame([], "group_id long, system_id long, motif_id long")
    new_p, new_g = dynamics.insert_motif(p, g, m, s, 1, 0)
    assert new_p.count() == 6 and new_g.count() == 2 and new_p.select("particle_id").distinct().count() == 6
    gone, groups = dynamics.delete_motif(new_p.select(*[c for c in new_p.columns]), new_g, 1, 0)
    assert gone.count() == 6 and groups.count() == 2


def test_composition(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, -1.0)], "id long, v double")
    add, twice = (lambda d, n: d.withColumn("v", F.col("v") + 1)), (lambda d, n: d.withColumn("v", F.col("v") * 2))
    at = lambda step: [r.v for r in step(rows, 0).orderBy("id").collect()]
    assert at(dynamics.sequential(add, twice)) == [4.0, 0.0] and at(dynamics.palindrome(add, twice)) == [9.0, 1.0] and at(dynamics.repeated(add, 3)) == [4.0, 2.0]
    assert at(dynamics.reset_on_error(add, F.col("v") > 1.5, "id")) == [1.0, 0.0]
    assert at(dynamics.switched([add, twice], [1.0, 0.0], 1)) == [2.0, 0.0]


def test_tuner_adjusts_on_the_wrap_only(spark):
    t = spark.range(8).select(F.lit(0).cast("long").alias("system_id"), F.col("id").alias("step"), F.lit(1.0).alias("acceptance"))
    widths = [r.width for r in tuning.tuned(t, 4).orderBy("step").collect()]
    assert widths == pytest.approx([1, 1, 1, 1.1, 1.1, 1.1, 1.1, 1.21])


# --- sources, streaming --------------------------------------------------------------------------------------------

CIF = """data_x
_cell_length_a 4.0(1)
_cell_length_b 5.0
_cell_length_c 6.0
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 60
_symmetry_space_group_name_H-M 'P 1'
loop_
_atom_site_label
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
_atom_site_charge
Ar1 Ar 0.5 0.0 0.0 0.25
Ar2 Ar 0.0 1.0 -0.5 -0.25
"""


def test_structure_file(spark, tmp_path):
    (tmp_path / "a.cif").write_text(CIF)
    (tmp_path / "b.cif").write_text(CIF.split("loop_")[0])
    s, p = structures.read_cif(spark, str(tmp_path / "*.cif"))
    assert s.count() == 2
    got = sorted((r.label, round(r.x, 6), round(r.y, 6), round(r.z, 6), r.charge) for r in p.collect())
    assert got == [("Ar1", 2.0, 0.0, 0.0, 0.25), ("Ar2", 2.5, round(5 * math.sin(math.radians(60)), 6), -3.0, -0.25)]


def test_trajectory_sink_and_reader(spark, tmp_path):
    t = spark.range(25).select(F.lit(0).cast("long").alias("system_id"), F.col("id").alias("step"), (F.col("id") * 2.0).alias("v"))
    path = str(tmp_path / "run")
    trajectories.write(t, path, "r1", "energies", 5)
    trajectories.write(t, path, "r1", "fixed")
    assert trajectories.groups(spark, path, "r1") == ["energies", "fixed"] and trajectories.slots(25, 5) == 5
    assert [r.step for r in trajectories.read(spark, path, "r1", "energies", 1, 4).orderBy("step").collect()] == [5, 10, 15]
    assert [tuple(r) for r in trajectories.deserialise(trajectories.serialise(t.limit(1)), "system_id long, step long, v double").collect()] == [(0, 0, 0.0)]


def test_streams(spark, tmp_path):
    t = spark.range(40).select((F.col("id") % 2).alias("system_id"), F.floor(F.col("id") / 2).alias("step"), F.lit(1.0).alias("acceptance"))
    path = str(tmp_path / "in")
    t.where("step < 10").write.parquet(path)
    t.where("step >= 10").write.mode("append").parquet(path)
    stream = streams.read_stream(spark, path, t.schema)
    q = streams.running_means(stream, "acceptance", 10).writeStream.outputMode("complete").format("memory").queryName("means").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.system_id, r.block, r.n) for r in spark.table("means").collect()) == [(0, 0, 10), (0, 1, 10), (1, 0, 10), (1, 1, 10)]
    q = streams.to_tables(streams.read_stream(spark, path, t.schema), {"*": str(tmp_path / "out")}, str(tmp_path / "c"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    q = streams.tuned_stream(streams.read_stream(spark, path, t.schema), 4).writeStream.outputMode("append").format("memory").queryName("widths").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("widths").count() == 40


def test_erfc_to_twelve_digits(spark):
    from corpuscle.functions.special import erfc

    xs = [i / 37 for i in range(-200, 960)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.erfc(r.x)) <= 2e-12 * math.erfc(r.x) for r in got)


def _all_pairs(r, box, sigma, epsilon, cutoff):
    energy, forces = 0.0, [[0.0] * 3 for _ in r]
    for i in range(len(r)):
        for j in range(len(r)):
            d = [b - a - h * round((b - a) / h) for a, b, h in zip(r[i], r[j], box, strict=True)]
            r2 = sum(c * c for c in d)
            if i != j and r2 < cutoff * cutoff:
                s6 = (sigma * sigma / r2) ** 3
                energy += 2 * epsilon * (s6 * s6 - s6)
                forces[i] = [f + 24 * epsilon * (s6 - 2 * s6 * s6) / r2 * c for f, c in zip(forces[i], d, strict=True)]
    return energy, forces


@pytest.mark.parametrize("cutoff", [0.3, 0.9, 1.4])
def test_blocks_of_pairs_give_all_forces(cutoff, monkeypatch):
    r, box = np.random.default_rng(3).uniform(-1.6, 1.6, (60, 3)), np.array([2.0, 1.5, 1.8])
    energy, forces = _all_pairs(r, box, 0.2, 0.5, cutoff)
    for pairs in (1, 150, 1 << 18):  # also blocks of one and of a few particles
        monkeypatch.setattr(dynamics, "PAIRS_AT_ONCE", pairs)
        got = dynamics._lj_numpy(r, box, 0.2, 0.5, cutoff)
        assert got[0] == pytest.approx(energy, rel=1e-9) and np.allclose(got[1], forces, rtol=1e-8, atol=1e-9 * np.abs(forces).max())


def _peak_mb(f) -> float:
    import tracemalloc

    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_md_memory_grows_with_particles_not_pairs():
    r = np.random.default_rng(4).normal(0, 0.12, (2500, 3))
    assert _peak_mb(lambda: dynamics._lj_numpy(r, np.full(3, 2.0), 0.02, 1e-6, 0.2)) < 50  # all pairs at once: 150 for one array


@pytest.mark.parametrize("optimizer", ["fire", "lbfgs"])
def test_relaxation_memory_grows_with_particles_not_pairs(optimizer):
    r = np.random.default_rng(5).normal(0, 0.12, (2500, 3))
    forces = lambda x: dynamics._lj_numpy(x, np.full(3, 2.0), 0.02, 1e-6, 0.2)[:2]
    assert _peak_mb(lambda: dynamics.OPTIMIZERS[optimizer](r, forces, 2)) < 50
