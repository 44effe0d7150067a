"""Energies: edges joined to parameters, one expression for each edge, a sum for each system.

Pair terms count both directions of an edge and are halved; bonded terms are not.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import COULOMB
from ..functions.geometry import cross, dot, minus, norm, vec


def total(edges: DataFrame, energy: Column, systems: DataFrame, half: bool = False, name: str = "energy") -> DataFrame:
    """Sum for every system, 0 for systems without edges."""
    sums = edges.groupBy("system_id").agg((F.sum(energy) / (2 if half else 1)).alias(name))
    return systems.select("system_id").join(sums, "system_id", "left").fillna(0.0, [name])


def of_species(edges: DataFrame, particles: DataFrame, parameters: DataFrame, ends: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """Edges with the parameters of their ends' labels; parameters have label_i, label_j, ...

    Edges that have the labels already are only joined with the parameters, a table of a few rows.
    """
    if all(f"label_{k}" in edges.columns for k in ends):
        return edges.join(F.broadcast(parameters), [f"label_{k}" for k in ends])
    out = edges
    for k in ends:
        out = out.join(particles.select(F.col("particle_id").alias(k), F.col("label").alias(f"label_{k}")), k)
    return out.join(parameters, [f"label_{k}" for k in ends])


# --- Lennard-Jones -----------------------------------------------------------------------------------------------


def mix_lorentz_berthelot(species: DataFrame) -> DataFrame:
    """Pairs of species: arithmetic sigma, geometric epsilon. No sigma (or 0) is 1, no epsilon is 0."""
    own = species.select("label", F.when(F.coalesce("sigma", F.lit(0.0)) == 0, 1.0).otherwise(F.col("sigma")).alias("sigma"), F.coalesce("epsilon", F.lit(0.0)).alias("epsilon"))
    a, b = own.select(*(F.col(c).alias(f"{c}_i") for c in own.columns)), own.select(*(F.col(c).alias(f"{c}_j") for c in own.columns))
    return a.crossJoin(F.broadcast(b)).select("label_i", "label_j", ((F.col("sigma_i") + F.col("sigma_j")) / 2).alias("sigma"), F.sqrt(F.col("epsilon_i") * F.col("epsilon_j")).alias("epsilon"))


def _s6(r2: Column, sigma: Column) -> Column:
    q = sigma * sigma / r2
    return q * q * q


def lj(r2: Column, sigma: Column, epsilon: Column) -> Column:
    s6 = _s6(r2, sigma)
    return 4 * epsilon * (s6 * s6 - s6)


def lj_smooth(r2: Column, sigma: Column, epsilon: Column, cutoff: Column, start: Column) -> Column:
    """Lennard-Jones that falls smoothly to 0 between ``start`` and the cutoff."""
    rc, rt = cutoff * cutoff, start * start
    fall = (rc - r2) * (rc - r2) * (2 * r2 + rc - 3 * rt) / ((rc - rt) * (rc - rt) * (rc - rt))
    return F.when(r2 >= rc, 0.0).when(r2 > rt, lj(r2, sigma, epsilon) * fall).otherwise(lj(r2, sigma, epsilon))


def lj_energy(edges: DataFrame, particles: DataFrame, parameters: DataFrame, systems: DataFrame) -> DataFrame:
    pairs = of_species(edges, particles, parameters)
    return total(pairs, lj(F.col("r2"), F.col("sigma"), F.col("epsilon")), systems, half=True)


def lj_forces(edges: DataFrame, particles: DataFrame, parameters: DataFrame) -> DataFrame:
    """Force on every particle: F_i = sum over j of dU/dr (r_j - r_i) / r, zero without neighbors."""
    pairs = of_species(edges, particles, parameters)
    s6 = _s6(F.col("r2"), F.col("sigma"))
    slope = 24 * F.col("epsilon") * (s6 - 2 * s6 * s6) / F.col("r2")
    sums = pairs.groupBy(F.col("i").alias("particle_id")).agg(*(F.sum(slope * F.col(f"d{a}")).alias(f"f{a}") for a in "xyz"))
    return particles.select("particle_id", "system_id").join(sums, "particle_id", "left").fillna(0.0, ["fx", "fy", "fz"])


def lj_virial(edges: DataFrame, particles: DataFrame, parameters: DataFrame, systems: DataFrame) -> DataFrame:
    """Nine sums w_ab = 1/2 sum over edges of r_a dU/dr r_b / r."""
    pairs = of_species(edges, particles, parameters)
    s6 = _s6(F.col("r2"), F.col("sigma"))
    slope = 24 * F.col("epsilon") * (s6 - 2 * s6 * s6) / F.col("r2")
    names = [f"w{a}{b}" for a in "xyz" for b in "xyz"]
    sums = pairs.groupBy("system_id").agg(*((F.sum(slope * F.col(f"d{n[1]}") * F.col(f"d{n[2]}")) / 2).alias(n) for n in names))
    return systems.select("system_id").join(sums, "system_id", "left").fillna(0.0, names)


def _species_counts(particles: DataFrame) -> DataFrame:
    return particles.where("label is not null").groupBy("system_id", "label").agg(F.count("*").alias("n"))


def _tail(particles: DataFrame, parameters: DataFrame, systems: DataFrame, value: Column, name: str) -> DataFrame:
    n = _species_counts(particles)
    a, b = n.select("system_id", F.col("label").alias("label_i"), F.col("n").alias("n_i")), n.select("system_id", F.col("label").alias("label_j"), F.col("n").alias("n_j"))
    pairs = a.join(b, "system_id").join(parameters, ["label_i", "label_j"]).join(systems.select("system_id", "cutoff", (F.col("ax") * F.col("by") * F.col("cz")).alias("volume")), "system_id")
    return total(pairs, value, systems, name=name)


def lj_tail_energy(particles: DataFrame, parameters: DataFrame, systems: DataFrame) -> DataFrame:
    """Energy of the pairs beyond the cutoff in a uniform fluid, over ordered pairs of species."""
    q = F.pow(F.col("sigma") / F.col("cutoff"), 3)
    value = 8 * math.pi / 3 * F.col("n_i") * F.col("n_j") / F.col("volume") * F.col("epsilon") * F.pow("sigma", F.lit(3)) * (q * q * q / 3 - q)
    return _tail(particles, parameters, systems, value, "energy")


def lj_tail_pressure(particles: DataFrame, parameters: DataFrame, systems: DataFrame) -> DataFrame:
    q = F.pow(F.col("sigma") / F.col("cutoff"), 3)
    value = 16 * math.pi / 3 * F.col("n_i") * F.col("n_j") / (F.col("volume") * F.col("volume")) * F.col("epsilon") * F.pow("sigma", F.lit(3)) * (2 * q * q * q / 3 - q)
    return _tail(particles, parameters, systems, value, "pressure")


# --- charges, bonds, angles, dihedrals ----------------------------------------------------------------------------


def with_charges(edges: DataFrame, particles: DataFrame) -> DataFrame:
    for k in ("i", "j"):
        edges = edges.join(particles.select(F.col("particle_id").alias(k), F.col("charge").alias(f"q_{k}")), k)
    return edges


def coulomb_energy(edges: DataFrame, particles: DataFrame, systems: DataFrame) -> DataFrame:
    """Sum of q_i q_j / r in vacuum."""
    return total(with_charges(edges, particles), COULOMB * F.col("q_i") * F.col("q_j") / F.sqrt("r2"), systems, half=True)


def harmonic_bond(r: Column, x0: Column, k: Column) -> Column:
    return k * (r - x0) * (r - x0)


def morse_bond(r: Column, r0: Column, depth: Column, alpha: Column) -> Column:
    q = 1 - F.exp(-alpha * (r - r0))
    return depth * q * q


def angle_between(a: tuple, b: tuple) -> Column:
    """Angle of two vectors in radians; rounding beyond -1 or 1 is cut."""
    c = dot(a, b) / (norm(a) * norm(b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def harmonic_angle(degrees: Column, theta0: Column, k: Column) -> Column:
    return k * (degrees - theta0) * (degrees - theta0)


def cosine_angle(theta: Column, theta0: Column, k: Column) -> Column:
    """Three-term cosine angle with its minimum at theta0 (radians); within five degrees of straight, k (1 + cos)."""
    s2 = F.pow(F.sin(theta0), 2)
    c2 = 1 / (4 * F.when(s2 == 0, 1.0).otherwise(s2))
    c1, c0 = -4 * c2 * F.cos(theta0), c2 * (2 * F.pow(F.cos(theta0), 2) + 1)
    return F.when(F.abs(theta0 - math.pi) < math.radians(5), k * (1 + F.cos(theta))).otherwise(k * (c0 + c1 * F.cos(theta) + c2 * F.cos(2 * theta)))


def dihedral_angle(b1: tuple, b2: tuple, b3: tuple) -> Column:
    """Angle about the middle bond, by atan2."""
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.atan2(dot(cross(n1, n2), b2) / norm(b2), dot(n1, n2))


def dihedral(phi: Column, v: Column, n: Column, phi0: Column) -> Column:
    return 0.5 * v * (1 - F.cos(n * phi0) * F.cos(n * phi))


def inversion(omega: Column, k: Column, c0: Column, c1: Column, c2: Column) -> Column:
    return k * (c0 + c1 * F.cos(omega) + c2 * F.cos(2 * omega))


def out_of_plane(ij: tuple, ik: tuple, il: tuple) -> Column:
    """Angle between il and the plane of ij and ik."""
    n = cross(ij, ik)
    s = dot(n, il) / (norm(n) * norm(il))
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)))


def uff_bond_length(ri: Column, rj: Column, xi: Column, xj: Column) -> Column:
    """Sum of the radii less the electronegativity correction."""
    d = F.sqrt(xi) - F.sqrt(xj)
    return ri + rj - ri * rj * d * d / (xi * ri + xj * rj)


def morse_from_harmonic(k: Column, depth: Column) -> Column:
    return F.sqrt(k / depth)


def morse_from_uff(zi: Column, zj: Column, r: Column, depth: Column) -> Column:
    return F.sqrt(664.12 * zi * zj / (r * r * r) / (2 * depth))


def uff_angle_constant(zi: Column, zk: Column, rij: Column, rjk: Column, theta0: Column) -> Column:
    """Force constant of a cosine angle from effective charges and bond lengths."""
    c = F.cos(theta0)
    rik2 = rij * rij + rjk * rjk - 2 * rij * rjk * c
    return 664.12 * zi * zk / F.pow(rik2, 2.5) * rij * rjk * (3 * rij * rjk * (1 - c * c) - rik2 * c)


def uff_torsion(sp_j: Column, sp_k: Column, v_j: Column, v_k: Column, u_j: Column, u_k: Column, order: Column) -> dict[str, Column]:
    """Barrier, periodicity and phase (degrees) by the hybridisation (3: sp3, 2: sp2) of the middle atoms."""
    both3, both2 = (sp_j == 3) & (sp_k == 3), (sp_j == 2) & (sp_k == 2)
    v = F.when(both3, F.sqrt(v_j * v_k)).when(both2, 5 * F.sqrt(u_j * u_k) * (1 + 4.18 * F.ln(order))).otherwise(F.lit(1.0))
    n = F.when(both3, 3).when(both2, 2).otherwise(6)
    return {"v": v, "n": n, "phi0": F.when(both3, 180.0).when(both2, 180.0).otherwise(0.0)}


# --- blocking spheres, motifs -------------------------------------------------------------------------------------


def blocking_energy(particles: DataFrame, spheres: DataFrame, systems: DataFrame) -> DataFrame:
    """Infinite for systems with a particle inside a sphere of its motif, else 0. Nearest images."""
    from ..functions.geometry import cell, wrap

    s = spheres.select("system_id", "motif_id", *(F.col(a).alias(f"_{a}") for a in "xyz"), "radius")
    near = particles.join(s, ["system_id", "motif_id"]).join(systems, "system_id")
    d = wrap(minus(vec("_"), vec()), cell())
    hit = near.where(dot(d, d) < F.col("radius") * F.col("radius")).select("system_id").distinct().withColumn("energy", F.lit(float("inf")))
    return systems.select("system_id").join(hit, "system_id", "left").fillna(0.0, ["energy"])


def internal_energy(groups: DataFrame, motif_energies: DataFrame, systems: DataFrame) -> DataFrame:
    """Each group's energy is its motif's."""
    return total(groups.join(motif_energies, "motif_id"), F.col("motif_energy"), systems)


# --- combinators --------------------------------------------------------------------------------------------------


def summed(*terms: DataFrame) -> DataFrame:
    """Sum of energy tables by system."""
    return reduce(DataFrame.unionByName, terms).groupBy("system_id").agg(F.sum("energy").alias("energy"))


def scaled_energy(term: DataFrame, factor: float) -> DataFrame:
    return term.withColumn("energy", F.col("energy") * factor)


def mapped(term: DataFrame, f) -> DataFrame:  # noqa: ANN001
    return term.withColumn("energy", f(F.col("energy")))


def updated(cached: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Incremental energy: the cached total, less that of vanished edges, plus that of new ones."""
    return summed(cached, scaled_energy(removed, -1.0), added)


