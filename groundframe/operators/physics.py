"""Stress columns, initial states and contact laws; formulas that only stand in for physics are named proxy_."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRESS = ("sxx", "syy", "szz", "txy", "tyz", "txz")


def mean_stress() -> Column:
    return (F.col("sxx") + F.col("syy") + F.col("szz")) / 3


def j2() -> Column:
    """Second invariant of the stress deviator (FN-12)."""
    m = mean_stress()
    return ((F.col("sxx") - m) ** 2 + (F.col("syy") - m) ** 2 + (F.col("szz") - m) ** 2) / 2 + F.col("txy") ** 2 + F.col("tyz") ** 2 + F.col("txz") ** 2


def von_mises() -> Column:
    return F.sqrt(3 * j2())


def principal_stresses() -> list[Column]:
    """Eigenvalues of the stress tensor, greatest first, in closed form by the Lode angle (FN-13)."""
    m, second = mean_stress(), j2()
    a, b, c = F.col("sxx") - m, F.col("syy") - m, F.col("szz") - m
    d, e, f = F.col("txy"), F.col("tyz"), F.col("txz")
    third = a * (b * c - e * e) - d * (d * c - e * f) + f * (d * e - b * f)
    r = F.sqrt(second / 3)
    ratio = F.when(r > 0, third / (2 * r**3)).otherwise(0.0)
    t = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))) / 3
    return [m + 2 * r * F.cos(t), m + 2 * r * F.cos(t - 2 * math.pi / 3), m + 2 * r * F.cos(t + 2 * math.pi / 3)]


def drucker_prager(cohesion: Column, phi_deg: Column) -> tuple[Column, Column]:
    """(alpha, k) of the cone through a Mohr-Coulomb surface's compression edges (FN-14)."""
    s, c = F.sin(F.radians(phi_deg)), F.cos(F.radians(phi_deg))
    low = math.sqrt(3) * (3 - s)
    return 2 * s / low, 6 * cohesion * c / low


def proxy_yield_value(cohesion: Column, phi_deg: Column) -> Column:
    """q + p sin(phi) - c cos(phi), p positive in compression: confinement raises it (FN-15; the usual sign is `yield_value`)."""
    p = F.greatest(F.lit(0.0), -mean_stress())
    return von_mises() + p * F.sin(F.radians(phi_deg)) - cohesion * F.cos(F.radians(phi_deg))


def yield_value(cohesion: Column, phi_deg: Column) -> Column:
    p = F.greatest(F.lit(0.0), -mean_stress())
    return von_mises() - p * F.sin(F.radians(phi_deg)) - cohesion * F.cos(F.radians(phi_deg))


def k0(given: Column, phi_deg: Column, default_phi: float = 30.0) -> Column:
    """Earth pressure at rest: as given, else 1 - sin(phi), within [0.05, 2] (FN-16)."""
    value = F.coalesce(given, 1 - F.sin(F.radians(F.coalesce(phi_deg, F.lit(default_phi)))))
    return F.greatest(F.lit(0.05), F.least(F.lit(2.0), value))


def initial_stress(cells: DataFrame, materials: DataFrame, *, ground: float, unit_weight: float = 18.0) -> DataFrame:
    """`cells` (material_id, z) with the six stresses at rest; compression is negative (PHY-04, JOIN-13)."""
    m = materials.select("material_id", "gamma", "phi", F.col("k0").alias("given"))
    out = cells.join(m, "material_id", "left")
    v = -F.coalesce("gamma", F.lit(unit_weight)) * F.greatest(F.lit(0.0), ground - F.col("z"))
    h = v * k0(F.col("given"), F.col("phi"))
    return out.withColumns({"sxx": h, "syy": h, "szz": v, **{k: F.lit(0.0) for k in STRESS[3:]}}).drop("gamma", "phi", "given")


def pore_pressure(z: Column, level: Column, gamma_water: float = 9.81) -> Column:
    """Water pressure below `level`, zero above (PHY-05)."""
    return F.greatest(F.lit(0.0), gamma_water * (level - z))


def contact_state(gap: Column, slip: Column, kn: Column, ks: Column, friction: Column, cohesion: Column) -> dict[str, Column]:
    """Coulomb contact: status open, stick or slip, and the tractions (NUM-25)."""
    normal = F.greatest(F.lit(0.0), -kn * gap)
    trial, most = ks * slip, cohesion + friction * normal
    status = F.when(gap > 0, "open").when(F.abs(trial) <= most, "stick").otherwise("slip")
    shear = F.when(status == "open", 0.0).when(status == "stick", trial).otherwise(F.signum(trial) * most)
    return {"status": status, "normal": F.when(gap > 0, 0.0).otherwise(normal), "shear": shear}
