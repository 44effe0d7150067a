"""Structure files and adsorbate descriptions as tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.geometry import lattice

_NUMBER = re.compile(r"^([-+]?[0-9.]+(?:[eE][-+]?\d+)?)(?:\(\d+\))?$")
_CELL = {"_cell_length_a": "a", "_cell_length_b": "b", "_cell_length_c": "c", "_cell_angle_alpha": "alpha", "_cell_angle_beta": "beta", "_cell_angle_gamma": "gamma"}


def _number(text: str) -> float:
    m = _NUMBER.match(text)
    if not m:
        raise ValueError(f"not a number: {text!r}")
    return float(m[1])


def parse_cif(text: str) -> tuple[dict[str, float], list[dict[str, object]]]:
    """Cell and atoms of a structure in space group P1."""
    cell: dict[str, float] = {}
    atoms: list[dict[str, object]] = []
    lines = [x.split("#")[0].strip() for x in text.splitlines()]
    i = 0
    while i < len(lines):
        words = lines[i].split()
        if len(words) == 2 and words[0] in _CELL:
            cell[_CELL[words[0]]] = _number(words[1])
        if words and words[0] in ("_symmetry_space_group_name_H-M", "_space_group_name_H-M_alt") and re.sub(r"[\s'\"]", "", " ".join(words[1:])) not in ("P1", ""):
            raise ValueError("only space group P1 is read")
        if words == ["loop_"]:
            names = []
            i += 1
            while i < len(lines) and lines[i].startswith("_"):
                names.append(lines[i].split()[0])
                i += 1
            while i < len(lines) and lines[i] and not lines[i].startswith(("_", "loop_", "data_")):
                if "_atom_site_fract_x" in names:
                    row = dict(zip(names, lines[i].split(), strict=False))
                    symbol = str(row.get("_atom_site_type_symbol") or re.sub(r"\d.*", "", row["_atom_site_label"]))
                    atoms.append({"label": str(row.get("_atom_site_label", symbol)), "symbol": symbol, "charge": _number(row["_atom_site_charge"]) if "_atom_site_charge" in row else 0.0, **{f: _number(row[f"_atom_site_fract_{a}"]) for f, a in zip(("fa", "fb", "fc"), "xyz", strict=True)}})
                i += 1
            continue
        i += 1
    if len(cell) != 6:
        raise ValueError("the cell is not complete")
    return cell, atoms


def read_cif(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Systems and particles of structure files; positions in a lower-triangular cell. Files are read and parsed by executors."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def parse(it: Iterable) -> Iterable:
        import pandas as pd

        for pdf in it:
            rows = []
            for path, text in zip(pdf.path, pdf.value, strict=True):
                cell, atoms = parse_cif(text)
                rows += [(path, -1, "", "", 0.0, 0.0, 0.0, 0.0, *cell.values())] if not atoms else []
                rows += [(path, n, a["label"], a["symbol"], a["charge"], a["fa"], a["fb"], a["fc"], *(cell[k] for k in ("a", "b", "c", "alpha", "beta", "gamma"))) for n, a in enumerate(atoms)]
            yield pd.DataFrame(rows, columns=["path", "n", "label", "symbol", "charge", "fa", "fb", "fc", "a", "b", "c", "alpha", "beta", "gamma"])

    atoms = files.mapInPandas(parse, "path string, n long, label string, symbol string, charge double, fa double, fb double, fc double, a double, b double, c double, alpha double, beta double, gamma double")
    h = lattice(*(F.col(c) for c in ("a", "b", "c", "alpha", "beta", "gamma")))
    placed = atoms.withColumns(h).withColumn("system_id", F.xxhash64("path"))
    systems = placed.groupBy("system_id").agg(F.first("path").alias("path"), *(F.first(c).alias(c) for c in h))
    from ..functions.geometry import cell as cell_columns
    from ..functions.geometry import to_real

    r = to_real((F.col("fa"), F.col("fb"), F.col("fc")), cell_columns())
    particles = placed.where("n >= 0").select(F.xxhash64("path", "n").alias("particle_id"), "system_id", *(c.alias(a) for c, a in zip(r, "xyz", strict=True)), "charge", "label", "symbol")
    return systems, particles


def motifs(spark: SparkSession, molecules: dict[int, list[dict]]) -> DataFrame:
    """Motif particles of adsorbates: motif id -> sites with x, y, z, mass, atomic_number, charge, label."""
    rows = []
    for motif, sites in sorted(molecules.items()):
        for s in sites:
            rows.append((len(rows), motif, *(float(s[a]) for a in "xyz"), float(s["mass"]), int(s["atomic_number"]), float(s.get("charge", 0.0)), str(s["label"])))
    return spark.createDataFrame(rows, schemas.MOTIFS)


# Geometry (Angstrom), masses (u) and charges (e) of the three-site carbon dioxide model.
CARBON_DIOXIDE = [
    {"x": 0.0, "y": 0.0, "z": 0.0, "mass": 12.011, "atomic_number": 6, "charge": 0.7, "label": "C_co2"},
    {"x": 0.0, "y": 0.0, "z": 1.16, "mass": 15.999, "atomic_number": 8, "charge": -0.35, "label": "O_co2"},
    {"x": 0.0, "y": 0.0, "z": -1.16, "mass": 15.999, "atomic_number": 8, "charge": -0.35, "label": "O_co2"},
]
