"""Physical constants (CODATA 2014) in Angstrom, electronvolt, elementary charge, kelvin."""

from __future__ import annotations

import math

ELEMENTARY_CHARGE = 1.6021766208e-19  # C
BOLTZMANN = 1.38064852e-23 / ELEMENTARY_CHARGE  # eV/K
PLANCK = 6.626070040e-34  # J s
AVOGADRO = 6.022140857e23  # 1/mol
VACUUM_PERMITTIVITY = 1.0 / (4.0e-7 * math.pi * 299792458.0**2)  # F/m
#: e^2 / (4 pi eps0) in eV Angstrom: energy of two unit charges at one Angstrom.
COULOMB = ELEMENTARY_CHARGE / (4 * math.pi * VACUUM_PERMITTIVITY) * 1e10
PASCAL = 1.0 / ELEMENTARY_CHARGE / 1e30  # eV/A^3
BAR = 1e5 * PASCAL
ATOMIC_MASS = 1.660539040e-27  # kg
#: Femtosecond in A sqrt(u / eV).
FEMTO_SECOND = 1e-15 * 1e10 * math.sqrt(ELEMENTARY_CHARGE / ATOMIC_MASS)
