"""Schemas of the entities, and checks that a frame has what an operator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "array<double>": T.ArrayType(T.DoubleType())}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(", "))])


CELL = "ax double, bx double, by double, cx double, cy double, cz double"
SYSTEMS = _schema(f"system_id long, {CELL}, temperature double, potential_energy double")
MD_SYSTEMS = _schema(
    f"system_id long, {CELL}, temperature double, potential_energy double, time_step double, friction_coefficient double, thermostat_time_constant double, "
    "target_pressure double, pressure_coupling_time double, compressibility double, minimum_scale_factor double"
)
PARTICLES = _schema("particle_id long, system_id long, x double, y double, z double, mass double, atomic_number long, charge double, label string")
MD_PARTICLES = _schema("particle_id long, system_id long, x double, y double, z double, mass double, atomic_number long, charge double, label string, px double, py double, pz double, gx double, gy double, gz double, exclusion_id long")
GUEST_PARTICLES = _schema("particle_id long, system_id long, x double, y double, z double, mass double, atomic_number long, charge double, label string, group_id long, motif_particle_id long")
GROUPS = _schema("group_id long, system_id long, motif_id long")
MOTIFS = _schema("motif_particle_id long, motif_id long, x double, y double, z double, mass double, atomic_number long, charge double, label string")
EDGES = _schema("system_id long, i long, j long, sx int, sy int, sz int")
SPECIES_PAIRS = _schema("label_i string, label_j string, sigma double, epsilon double")
BLOCKING_SPHERES = _schema("sphere_id long, system_id long, motif_id long, x double, y double, z double, radius double")
MD_STEPS = _schema("system_id long, step long, potential_energy double, kinetic_energy double, stress array<double>")
MC_STEPS = _schema("system_id long, step long, potential_energy double, stress_potential array<double>, stress_tail_correction array<double>, stress_ideal_gas array<double>")
MC_COUNTS = _schema("system_id long, motif_id long, step long, n long")
RELAX_STEPS = _schema("system_id long, step long, potential_energy double, max_force double, stress array<double>")
SCHEDULER_STATE = _schema("system_id long, value double, multiplicity double, target double, tolerance double, lower double, upper double, history array<double>, idx int")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Raises if a column is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df
