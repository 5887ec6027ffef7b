"""Strains and stresses of cells, and material laws over tables: elastic, Mohr-Coulomb, hardening soil with small-strain stiffness.

Tensors are arrays of six: xx, yy, zz, xy, yz, xz; strains have engineering shears; tension is positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import mesh
from .folds import waves

#: A tetrahedron of this volume or less has no strain.
THIN = 1e-14
SIX = np.array([[0, 3, 5], [3, 1, 4], [5, 4, 2]])


def lame(young, poisson) -> tuple:
    """Lamé's two constants, of columns or numbers."""
    return young * poisson / ((1 + poisson) * (1 - 2 * poisson)), young / (2 * (1 + poisson))


def hooke(young: Column, poisson: Column, strain: Column) -> Column:
    """Stress of an elastic strain (NUM-04, NUM-19)."""
    lam, mu = lame(young, poisson)
    bulk = lam * (strain[0] + strain[1] + strain[2])
    return F.array(*(bulk + 2 * mu * strain[i] for i in range(3)), *(mu * strain[i] for i in range(3, 6)))


def _tet_gradients(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(volumes, gradients of the four shape functions) of tetrahedra (n, 4, 3); gradients are 0 for those of hardly any volume."""
    a, b, c = (x[:, i] - x[:, 0] for i in (1, 2, 3))
    normals = np.stack([np.cross(b, c), np.cross(c, a), np.cross(a, b)], 1)
    det = (a * normals[:, 0]).sum(1)
    fine = np.abs(det) / 6 > THIN
    own = normals * np.where(fine, 1 / np.where(fine, det, 1), 0)[:, None, None]
    return np.where(fine, np.abs(det) / 6, 0), np.concatenate([-own.sum(1, keepdims=True), own], 1)


def strain_matrices(x: np.ndarray, tets: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(volumes, (n, 6, 3 k) matrices from k nodes' displacements to the mean strain) of cells (n, k, 3) made of tetrahedra (NUM-03)."""
    n, k = x.shape[:2]
    total, out = np.zeros(n), np.zeros((n, 6, 3 * k))
    for t in tets:
        volume, slope = _tet_gradients(x[:, list(t)])
        total += volume
        slope = slope * volume[:, None, None]
        for i, node in enumerate(t):
            dx, dy, dz = slope[:, i].T
            for row, axis, d in ((0, 0, dx), (1, 1, dy), (2, 2, dz), (3, 0, dy), (3, 1, dx), (4, 1, dz), (4, 2, dy), (5, 0, dz), (5, 2, dx)):
                out[:, row, 3 * node + axis] += d
    return total, out / np.where(total > 0, total, 1)[:, None, None]


def cell_strains(cells: DataFrame, nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """`cells` (tet4, hex8) with volume and strain, from nodes (node_id, x, y, z) and moves (node_id, ux, uy, uz) (NUM-03).

    A hexahedron is taken as five tetrahedra, and has their mean by volume. Tetrahedra of hardly any volume don't count; a cell
    without others, of another type, or with a node that has no place has null strain and volume 0; nodes without a move stay where
    they are. Nodes and moves are joined once and gathered by cell; matrices are then made and applied in Arrow batches.
    """
    moved = nodes.select("node_id", "x", "y", "z").join(moves.select("node_id", "ux", "uy", "uz"), "node_id", "left").fillna(0.0, ["ux", "uy", "uz"])
    at = moved.select("node_id", F.array("x", "y", "z", "ux", "uy", "uz").cast("array<double>").alias("p"))
    rest = [c for c in cells.columns if c not in ("cell_id", "volume", "strain")]
    flat = cells.select("cell_id", F.struct(*rest).alias("own"), F.posexplode("conn").alias("at", "node_id"))
    flat = flat.withColumn("own", F.when(F.col("at") == 0, F.col("own"))).join(at, "node_id", "left")
    whole = flat.groupBy("cell_id").agg(F.first("own", ignorenulls=True).alias("own"), F.array_sort(F.collect_list(F.struct("at", "p"))).alias("c"))
    known = F.forall("c", lambda x: x["p"].isNotNull())
    whole = whole.select("cell_id", "own", F.when(known, F.flatten(F.transform("c", lambda x: x["p"]))).alias("p"))

    @F.arrow_udf("struct<volume:double,strain:array<double>>")
    def told(kind: pa.Array, points: pa.Array) -> pa.Array:
        names, sizes = np.array(kind.to_pylist(), object), np.array([0 if p is None else len(p) for p in points.to_pylist()])
        volume, strain = np.zeros(len(names)), np.zeros((len(names), 6))
        for name, k, tets in (("tet4", 4, [(0, 1, 2, 3)]), ("hex8", 8, mesh.HEX_TETS)):
            rows = np.flatnonzero((names == name) & (sizes == 6 * k))
            if len(rows):
                p = _rows(points.take(pa.array(rows))).reshape(-1, k, 6)
                volume[rows], b = strain_matrices(p[:, :, :3], tets)
                strain[rows] = (b @ p[:, :, 3:].reshape(len(rows), 3 * k, 1))[:, :, 0]
        return pa.StructArray.from_arrays([pa.array(volume), _lists(strain)], names=["volume", "strain"])

    out = whole.withColumn("told", told(F.col("own.cell_type"), F.col("p")))
    return out.select("cell_id", "own.*", "told.volume", F.when(F.col("told.volume") > 0, F.col("told.strain")).alias("strain"))


def node_means(cells: DataFrame, *names: str) -> DataFrame:
    """(node_id, the named arrays of six): means over the cells round a node, by volume; cells without a value don't count (NUM-14)."""
    flat = cells.where(F.col(names[0]).isNotNull()).select(F.explode("conn").alias("node_id"), "volume", *names)
    means = [F.array(*(F.sum(F.col("volume") * F.col(n)[i]) / F.sum("volume") for i in range(6))).alias(n) for n in names]
    return flat.groupBy("node_id").agg(*means)


def von_mises(stress: Column) -> Column:
    m = (stress[0] + stress[1] + stress[2]) / 3
    return F.sqrt(1.5 * sum(((stress[i] - m) ** 2 for i in (1, 2)), (stress[0] - m) ** 2) + 3 * sum((stress[i] ** 2 for i in (4, 5)), stress[3] ** 2))


def advanced(states: DataFrame, *, floor: float = 1e6) -> DataFrame:
    """Cells' states (strain, stress, dstrain, young, poisson, cohesion) after an elastic step, with von_mises and yielded: more than six
    times the cohesion, and than `floor` (NUM-10)."""
    more = hooke(F.col("young"), F.col("poisson"), F.col("dstrain"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    out = states.withColumns({"strain": add("strain", "dstrain"), "stress": add(F.col("stress"), more)}).drop("dstrain")
    out = out.withColumn("von_mises", von_mises(F.col("stress")))
    return out.withColumn("yielded", F.col("von_mises") > F.greatest(6 * F.col("cohesion"), F.lit(floor)))


# --- arrays of many states at once -------------------------------------------------------------------------------------


def _elastic(lam: np.ndarray, mu: np.ndarray, e: np.ndarray) -> np.ndarray:
    out = mu[:, None] * e
    out[:, :3] += mu[:, None] * e[:, :3] + (lam * e[:, :3].sum(1))[:, None]
    return out


def _compliant(lam: np.ndarray, mu: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Elastic strain of a stress."""
    young, poisson = mu * (3 * lam + 2 * mu) / (lam + mu), lam / (2 * (lam + mu))
    out = s / mu[:, None]
    out[:, :3] = ((1 + poisson)[:, None] * s[:, :3] - (poisson * s[:, :3].sum(1))[:, None]) / young[:, None]
    return out


def _tensor(values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    t = (vectors * values[:, None, :]) @ vectors.transpose(0, 2, 1)
    return t[:, [0, 1, 2, 0, 1, 0], [0, 1, 2, 1, 2, 2]]


#: Yield planes by the principal stresses they hold apart, the most compressed first, and sets of them that may be active together.
PLANES = ((0, 1), (1, 2), (0, 2))
PLANE_NAMES = ("f12", "f23", "f13")
SETS = ((0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2))
MODES = ("elastic", "shear-single", "shear-edge", "shear-apex", "tension")
#: Sets tried, a set's planes by their values: violated ones within a share of the worst, then single ones, pairs, all.
SHARE, SETTLED = 0.05, 1e-7


def _plane_values(s: np.ndarray, n_phi: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.stack([s[:, i] - n_phi * s[:, j] - c for i, j in PLANES], 1)


def _solve(h: np.ndarray, f: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(h, f[..., None])[..., 0]
    except np.linalg.LinAlgError:  # some row's planes depend on each other
        return (np.linalg.pinv(h) @ f[..., None])[..., 0]


def shear_return(s: np.ndarray, n_phi: np.ndarray, n_psi: np.ndarray, c: np.ndarray, lam: np.ndarray, mu: np.ndarray):
    """Principal stresses (compression positive, falling) back on the surface: (stress, set, multiplier), set an index into SETS.

    All seven sets of planes are solved at once, for all rows. A row takes the first set, in its own order, that leaves no
    plane violated, else the one that leaves least; sets with a plane that isn't violated, a negative multiplier or principal stresses out
    of order don't count. A row without any keeps its stress.
    """
    n, f = len(s), _plane_values(s, n_phi, c)
    worst = f.max(1)
    normal, flow = np.zeros((n, 3, 3)), np.zeros((n, 3, 3))
    for k, (i, j) in enumerate(PLANES):
        normal[:, k, i], normal[:, k, j] = 1, -n_phi
        flow[:, k, i], flow[:, k, j] = 1, -n_psi
    pushed = 2 * mu[:, None, None] * flow + (lam[:, None] * flow.sum(2))[:, :, None]  # stiffness times each flow
    h = normal @ pushed.transpose(0, 2, 1)
    place = np.argsort(np.argsort(-f, axis=1, kind="stable"), axis=1)
    near = (f > 0) & (f >= (worst - np.maximum(1e-6, SHARE * worst))[:, None])
    key, left, got, total = np.zeros((n, 7)), np.full((n, 7), np.inf), np.zeros((n, 7, 3)), np.zeros((n, 7))
    for q, planes in enumerate(SETS):
        own = list(planes)
        step = _solve(h[:, own][:, :, own] + 1e-12 * np.eye(len(own)), f[:, own])
        got[:, q] = s - (pushed[:, own] * step[:, :, None]).sum(1)
        total[:, q] = step.sum(1)
        fine = (f[:, own] > 0).all(1) & (step >= -1e-10).all(1) & (np.diff(got[:, q], axis=1) <= 1e-8).all(1)
        left[:, q] = np.where(fine, np.maximum(_plane_values(got[:, q], n_phi, c), 0).max(1), np.inf)
        ranks = np.sort(place[:, own], axis=1)
        key[:, q] = 10 * len(own) + ranks[:, 0] + (3 * ranks[:, 1] if len(own) == 2 else 0)
        key[(near == np.isin([0, 1, 2], own)).all(1), q] = 0
    order = np.argsort(key, axis=1, kind="stable")
    best, chosen, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
    rows = np.arange(n)
    for turn in range(7):
        q = order[:, turn]
        better = ~done & (left[rows, q] < best)
        best, chosen = np.where(better, left[rows, q], best), np.where(better, q, chosen)
        done |= better & (best < SETTLED)
    none = chosen < 0
    first = np.argmax(f, axis=1)
    q = np.where(none, first, chosen)
    return np.where(none[:, None], s, got[rows, q]), q, np.where(none, worst, total[rows, q])


def mohr_coulomb_step(stress: np.ndarray, dstrain: np.ndarray, young, poisson, cohesion, friction, dilation, tension) -> dict[str, np.ndarray]:
    """Updates of n rows at once (NUM-20): stress, plastic (strain increment), margin, multiplier, mode and planes (as numbers)."""
    lam, mu = lame(young, poisson)
    slope = lambda deg: (1 + np.sin(np.radians(deg))) / np.maximum(1e-12, 1 - np.sin(np.radians(deg)))
    n_phi, n_psi = slope(friction), slope(dilation)
    c = 2 * cohesion * np.sqrt(np.maximum(n_phi, 1e-12))
    trial = stress + _elastic(lam, mu, dstrain)
    values, vectors = np.linalg.eigh(trial[:, SIX])
    margin = _plane_values(-values, n_phi, c).max(1)
    out, mode, planes, multiplier = trial.copy(), np.zeros(len(trial), int), np.full(len(trial), -1), np.zeros(len(trial))
    torn = (tension > 0) & (values > tension[:, None]).any(1)
    out[torn] = _tensor(np.minimum(values[torn], tension[torn, None]), vectors[torn])
    mode[torn] = 4
    k = np.flatnonzero(~torn & (margin > 0))
    if len(k):
        s, q, multiplier[k] = shear_return(-values[k], n_phi[k], n_psi[k], c[k], lam[k], mu[k])
        s[:, 2] = np.where(tension[k] > 0, np.maximum(s[:, 2], -tension[k]), s[:, 2])
        out[k] = _tensor(-s, vectors[k])
        planes[k], mode[k] = q, np.array([len(x) for x in SETS])[q]
    plastic = dstrain - _compliant(lam, mu, out - stress)
    plastic[mode == 0] = 0
    return {"stress": out, "plastic": plastic, "margin": margin, "multiplier": multiplier, "mode": mode, "planes": planes}


def _rows(a: pa.Array) -> np.ndarray:
    return np.asarray(a.flatten(), dtype=np.float64).reshape(len(a), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


LAW = ("young", "poisson", "cohesion", "friction", "dilation", "tension")


def _complete(arrays: list[str], numbers: tuple[str, ...]) -> Column:
    ok = F.lit(True)
    for a in arrays:
        ok = ok & F.coalesce((F.size(a) == 6) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    for c in numbers:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return ok & (F.col("young") > 0) & (F.col("poisson") < 0.5)


def _inputs(ok: Column) -> list[Column]:
    zero = F.array(*[F.lit(0.0)] * 6)
    arrays = [F.when(ok, F.col(c).cast("array<double>")).otherwise(zero) for c in ("stress", "dstrain")]
    return arrays + [F.when(ok, F.col(c).cast("double")).otherwise(F.lit(d)) for c, d in zip(LAW, (1.0, 0.0, 0.0, 0.0, 0.0, 0.0), strict=True)]


def mohr_coulomb(rows: DataFrame) -> DataFrame:
    """`rows` (stress, dstrain, young, poisson, cohesion, friction, dilation, tension; angles in degrees) with `update`: stress, plastic,
    margin, multiplier, mode and planes (NUM-20, NUM-28, NUM-29).

    The elastic trial is cut off at `tension` if that is more than zero and exceeded; else, where a shear plane is violated, its principal
    stresses return along the flow of the planes that are active (face, edge or apex). margin is the trial's greatest plane value. Rows
    with a null or an entry that is no number, or constants out of bounds, have a null update. Rows go through in Arrow batches.
    """

    @F.arrow_udf("struct<stress:array<double>,plastic:array<double>,margin:double,multiplier:double,mode:string,planes:string>")
    def told(stress: pa.Array, dstrain: pa.Array, e: pa.Array, nu: pa.Array, c: pa.Array, phi: pa.Array, psi: pa.Array, t: pa.Array) -> pa.Array:
        out = mohr_coulomb_step(_rows(stress), _rows(dstrain), *(np.asarray(x, dtype=np.float64) for x in (e, nu, c, phi, psi, t)))
        names = np.array(["+".join(PLANE_NAMES[k] for k in s) for s in SETS] + [""], object)
        fields = [_lists(out["stress"]), _lists(out["plastic"]), pa.array(out["margin"]), pa.array(out["multiplier"]), pa.array(np.array(MODES, object)[out["mode"]]), pa.array(names[out["planes"]])]
        return pa.StructArray.from_arrays(fields, names=["stress", "plastic", "margin", "multiplier", "mode", "planes"])

    # a column of its own, so that a row is looked at once, not for each of the inputs
    own, ok = rows.withColumn("_ok", _complete(["stress", "dstrain"], LAW)), F.col("_ok")
    return own.withColumn("update", told(*_inputs(ok))).withColumn("update", F.when(ok, F.col("update"))).drop("_ok")


def yield_report(updated: DataFrame, *keys: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """Per key, of `mohr_coulomb` rows: cells, yielded, their share, cells by mode, and `more` aggregates of the same pass (NUM-29)."""
    mode = F.col("update.mode")
    counts = [F.count_if(mode == m).alias(m.replace("-", "_")) for m in MODES]
    yielded = F.count_if(mode != "elastic")
    # rows without an update aren't counted; a filter would move below the update and have it made twice
    cells = F.count(mode)
    return updated.groupBy(*keys).agg(cells.alias("cells"), yielded.alias("yielded"), F.try_divide(yielded, cells).alias("share"), *counts, *more).where("cells > 0")


def consistent_tangent(rows: DataFrame, *, step: float = 1e-7, worst: float = 1e14) -> DataFrame:
    """`rows` as in `mohr_coulomb` with `tangent` (36 numbers by row), `condition` and `regularised`: central differences of the stress update at
    the row's stress, made symmetric (NUM-23).

    Twelve updates a row are computed in one batch. A matrix of a condition number beyond `worst` gets a small diagonal. `dstrain` is not
    read; a step is `step` times the size of `strain` where rows have that column and it is over one.
    """
    has = "strain" in rows.columns

    @F.arrow_udf("struct<tangent:array<double>,condition:double,regularised:boolean>")
    def told(stress: pa.Array, strain: pa.Array, e: pa.Array, nu: pa.Array, c: pa.Array, phi: pa.Array, psi: pa.Array, t: pa.Array) -> pa.Array:
        s, law = _rows(stress), [np.asarray(x, dtype=np.float64) for x in (e, nu, c, phi, psi, t)]
        h = step * np.maximum(1, np.abs(_rows(strain)))
        tangent = np.zeros((len(s), 6, 6))
        moves = np.concatenate([sign * np.eye(6)[j] * h[:, j, None] for j in range(6) for sign in (1, -1)])
        out = mohr_coulomb_step(np.tile(s, (12, 1)), moves, *(np.tile(x, 12) for x in law))["stress"].reshape(6, 2, len(s), 6)
        for j in range(6):
            tangent[:, :, j] = (out[j, 0] - out[j, 1]) / (2 * h[:, j, None])
        tangent = (tangent + tangent.transpose(0, 2, 1)) / 2
        cond = np.linalg.cond(tangent)
        bad = ~np.isfinite(cond) | (cond > worst)
        lift = np.maximum(1e-10 * np.abs(np.diagonal(tangent, axis1=1, axis2=2)).max(1), 1e-9)
        tangent[bad] += lift[bad, None, None] * np.eye(6)
        return pa.StructArray.from_arrays([_lists(tangent.reshape(len(s), 36)), pa.array(np.linalg.cond(tangent)), pa.array(bad)], names=["tangent", "condition", "regularised"])

    checked, ok = rows.withColumn("_ok", _complete(["stress", *(["strain"] if has else [])], LAW)), F.col("_ok")
    zero = F.array(*[F.lit(0.0)] * 6)
    inputs = _inputs(ok) if "dstrain" in rows.columns else [F.when(ok, F.col("stress")).otherwise(zero), zero, *(F.when(ok, F.col(c).cast("double")).otherwise(F.lit(d)) for c, d in zip(LAW, (1.0, 0.0, 0.0, 0.0, 0.0, 0.0), strict=True))]
    inputs[1] = F.when(ok, F.col("strain")).otherwise(zero) if has else zero
    own = checked.withColumn("_told", told(*inputs)).withColumn("_told", F.when(ok, F.col("_told")))
    return own.select(*rows.columns, "_told.tangent", "_told.condition", "_told.regularised")


# --- histories -----------------------------------------------------------------------------------------------------------

#: Constants of the hardening law; shear0 and gamma07 may be null (then small strains have no extra stiffness).
SOIL = ("young50", "young_oed", "young_ur", "poisson", "p_ref", "power", "cohesion", "friction", "dilation", "shear0", "gamma07", "failure")
HISTORY_MODES = ("elastic", "shear", "cap", "double")
NUMBERS = ("eps_shear", "eps_vol", "eps_cap", "eps_unload", "eps_eq", "p", "q", "p_cap", "ocr", "gamma_hist", "gamma_rev", "gamma_max", "reduction", "margin", "shear_modulus")


def hardening_start(par: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The state before the first increment."""
    n = len(par["p_ref"])
    out = {k: np.zeros(n) for k in NUMBERS} | {k: np.zeros((n, 6)) for k in ("stress", "strain", "plastic")}
    with_small = ~np.isnan(par["shear0"])
    first = np.where(with_small, par["shear0"], par["young50"] / (2 * (1 + par["poisson"])))
    return out | {"p": par["p_ref"].copy(), "p_cap": 1.5 * par["p_ref"], "ocr": np.full(n, 1.5), "reduction": np.ones(n), "shear_modulus": first, "unloading": np.zeros(n, bool), "mode": np.zeros(n, int)}


def hardening_step(state: dict[str, np.ndarray], de: np.ndarray, par: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One increment for n states at once (NUM-21): stiffness by stress level, direction and strain since the last turn, then a
    shear cone and a cap, each with its hardening."""
    new = {k: v.copy() for k, v in state.items()}
    gamma = np.sqrt((de[:, 3:] ** 2).sum(1))
    unloading = (state["stress"] * de).sum(1) < 0
    new["unloading"] = unloading
    new["gamma_hist"] = state["gamma_hist"] + gamma
    new["gamma_rev"] = np.where(unloading == state["unloading"], state["gamma_rev"] + gamma, gamma)
    new["gamma_max"] = np.maximum(state["gamma_max"], new["gamma_hist"])
    small = ~np.isnan(par["shear0"])
    with np.errstate(invalid="ignore"):
        new["reduction"] = np.where(small & ~np.isnan(par["gamma07"]), 1 / (1 + new["gamma_rev"] / par["gamma07"]), 1.0)
    level = (np.maximum(state["p"], 1) / par["p_ref"]) ** par["power"]
    young = np.maximum(1e3, np.where(unloading, par["young_ur"], par["young50"]) * level)
    stiff = 2 * (1 + par["poisson"]) * np.where(small, par["shear0"], 0) * level * new["reduction"]
    young = np.where(small, np.maximum(young, np.minimum(stiff, np.maximum(3 * par["young_ur"], young))), young)
    lam, mu = lame(young, np.clip(par["poisson"], 1e-3, 0.49))
    bulk = lam + 2 * mu / 3
    trial = state["stress"] + _elastic(lam, mu, de)
    p = -trial[:, :3].mean(1)
    dev = trial.copy()
    dev[:, :3] += p[:, None]
    q = np.sqrt(np.maximum(0, 1.5 * ((dev[:, :3] ** 2).sum(1) + 2 * (dev[:, 3:] ** 2).sum(1))))
    cone = lambda deg: 6 * np.sin(np.radians(deg)) / (np.sqrt(3) * np.maximum(1e-12, 3 - np.sin(np.radians(deg))))
    alpha, beta = cone(par["friction"]), cone(par["dilation"])
    held = par["cohesion"] * par["failure"] * (1 + 3 * state["eps_shear"])
    k = 6 * held * np.cos(np.radians(par["friction"])) / (np.sqrt(3) * np.maximum(1e-12, 3 - np.sin(np.radians(par["friction"]))))
    fs, fc = q + alpha * p - k, p - state["p_cap"]
    yields = (fs > 0) | (fc > 0)
    # the cone
    hard_s = np.maximum(1e-9, 0.15 * par["young50"] * (1 + 1.5 * state["eps_shear"]))
    hard_c = np.maximum(1e-9, 0.10 * par["young_oed"] * (1 + state["eps_vol"]))
    ds = np.where(yields & (fs > 0), fs / np.maximum(3 * mu + alpha * beta * bulk + hard_s, 1e-12), 0)
    direction = dev / np.maximum(q, 1e-12)[:, None]
    sheared = ds > 0
    p1, q1 = p - ds * beta * bulk, np.where(sheared, np.maximum(0, q - 3 * mu * ds), q)
    stress = trial.copy()
    stress[sheared] = q1[sheared, None] * direction[sheared]
    stress[sheared, :3] -= p1[sheared, None]
    plastic = ds[:, None] * direction
    plastic[:, :3] += (ds * beta / 3)[:, None]
    # the cap
    capped = yields & ((fc > 0) | (p1 > state["p_cap"]))
    dc = np.where(capped, np.maximum(fc, p1 - state["p_cap"]) / np.maximum(bulk + hard_c, 1e-12), 0)
    stress[:, :3] += (dc * bulk)[:, None]
    plastic[:, :3] += (dc / 3)[:, None]
    p2 = p1 - dc * bulk
    none = np.sqrt((plastic**2).sum(1)) < 1e-14
    plastic[none] = (de - _compliant(lam, mu, stress - state["stress"]))[none]
    plastic[~yields] = 0
    new |= {
        "stress": stress, "strain": state["strain"] + de, "plastic": state["plastic"] + plastic, "p": np.maximum(1, p2), "q": q1, "margin": np.maximum(fs, fc), "shear_modulus": mu,
        "mode": np.where(sheared & capped, 3, np.where(capped, 2, np.where(sheared, 1, 0))), "eps_shear": state["eps_shear"] + ds, "eps_cap": state["eps_cap"] + dc,
        "eps_vol": state["eps_vol"] + dc + np.abs(beta * ds) / 2, "eps_unload": state["eps_unload"] + np.where(yields & unloading, gamma, 0),
        "eps_eq": state["eps_eq"] + np.sqrt((plastic**2).sum(1)),
    }
    cap = np.where(yields, np.maximum(state["p_cap"] + dc * hard_c, par["p_ref"]), state["p_cap"])
    new["ocr"] = np.where(yields, np.maximum(1, cap / np.maximum(1, p2)), state["ocr"])
    new["p_cap"] = cap
    return new


def hardening_history(increments: DataFrame) -> DataFrame:
    """Increments (cell, seq, dstrain and the constants of SOIL) with `state` after each, folded in order of seq within a cell (NUM-21).

    A cell's rows are brought together and sorted by Spark, and stream through in Arrow batches: of a batch, the first rows of all cells are updated
    at once, then the second ones; only the last cell's state is carried to the next batch, so a history of any length takes no more memory. A
    cell's constants are those of each row. Rows with a null cell, seq or number (other than shear0 and gamma07), or an increment not of six numbers, are left out.
    """
    ok = F.col("cell").isNotNull() & F.col("seq").isNotNull() & F.coalesce((F.size("dstrain") == 6) & F.forall("dstrain", lambda x: x.isNotNull()), F.lit(False))
    for c in SOIL:
        if c not in ("shear0", "gamma07"):
            ok = ok & F.col(c).isNotNull()
    rows = increments.where(ok).select("cell", "seq", F.col("dstrain").cast("array<double>").alias("dstrain"), *(F.col(c).cast("double").alias(c) for c in SOIL))
    keys = [StructField(c, rows.schema[c].dataType) for c in ("cell", "seq")]
    kinds = "struct<stress:array<double>,plastic:array<double>,mode:string,unloading:boolean," + ",".join(f"{k}:double" for k in NUMBERS) + ">"
    schema = StructType([*keys, *StructType.fromDDL(f"state {kinds}")])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column("cell").to_pandas().to_numpy()
            de, par = _rows(b.column("dstrain")), {c: np.asarray(b.column(c).to_pandas(), dtype=np.float64) for c in SOIL}
            slot = np.cumsum(np.r_[False, names[1:] != names[:-1]])
            firsts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            state = hardening_start({c: v[firsts] for c, v in par.items()})
            if held is not None and names[0] == last:
                for key, v in held.items():
                    state[key][0] = v
            out = {}
            for wave in waves(slot):
                at = slot[wave]
                got = hardening_step({k: v[at] for k, v in state.items()}, de[wave], {c: v[wave] for c, v in par.items()})
                for k, v in got.items():
                    state[k][at] = v
                    out.setdefault(k, np.zeros((len(names), *v.shape[1:]), v.dtype))[wave] = v
            last, held = names[-1], {k: v[-1].copy() for k, v in state.items()}
            fields = [_lists(out["stress"]), _lists(out["plastic"]), pa.array(np.array(HISTORY_MODES, object)[out["mode"]]), pa.array(out["unloading"]), *(pa.array(out[k]) for k in NUMBERS)]
            states = pa.StructArray.from_arrays(fields, names=["stress", "plastic", "mode", "unloading", *NUMBERS])
            yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("seq"), states], names=["cell", "seq", "state"])

    return rows.repartition("cell").sortWithinPartitions("cell", "seq").mapInArrow(fold, schema)


# --- contacts ------------------------------------------------------------------------------------------------------------


def contact_step(s: np.ndarray, m: np.ndarray, kn, ks, friction, cohesion, tolerance: float) -> dict[str, np.ndarray]:
    """n pairs of points (place and displacement) at once: gap, force, limit, status (0 open, 1 stick, 2 slip) and stiffness (n, 3, 3)."""
    far = m[:, :3] - s[:, :3]
    length = np.sqrt((far**2).sum(1))
    normal = np.where((length > 1e-14)[:, None], far / np.maximum(length, 1e-300)[:, None], [0.0, 0.0, 1.0])
    jump = far + m[:, 3:] - s[:, 3:]
    gap = (jump * normal).sum(1)
    trial = ks[:, None] * (jump - gap[:, None] * normal)
    size, force = np.sqrt((trial**2).sum(1)), np.maximum(0, -kn * gap)
    limit = np.maximum(0, cohesion + np.tan(np.radians(friction)) * force)
    status = np.where(gap > tolerance, 0, np.where(size <= limit + 1e-12, 1, 2))
    slide = trial / np.maximum(size, 1e-12)[:, None]
    nn = normal[:, :, None] * normal[:, None, :]
    across = np.eye(3) - nn
    rest = np.where((status == 1)[:, None, None], across, (limit / np.maximum(size, 1e-12))[:, None, None] * (across - slide[:, :, None] * slide[:, None, :]))
    stiffness = kn[:, None, None] * nn + ks[:, None, None] * rest
    return {"gap": gap, "force": force, "limit": limit, "status": status, "stiffness": np.where((status == 0)[:, None, None], 0, stiffness)}


STATES = ("open", "stick", "slip")


def contact_pairs(pairs: DataFrame, *, tolerance: float = 1e-9) -> DataFrame:
    """Node pairs (slave, master, kn, ks, friction in degrees, cohesion, and points s and m with displacements) with gap, force, limit, status and stiffness (NUM-22, NUM-24).

    s and m are structs of x, y, z, ux, uy, uz. The normal runs from the slave's place to the master's (up, if they are in one place); a gap beyond
    `tolerance` is open, and its stiffness null. A pair that slides loses the stiffness along its slide and keeps a part across it. With a
    null or a value that is no number among what is read, all is null. Pairs go through in Arrow batches.
    """
    axes = ("x", "y", "z", "ux", "uy", "uz")
    numbers = [F.col(p)[k] for p in ("s", "m") for k in axes] + [F.col(c) for c in ("kn", "ks", "friction", "cohesion")]
    ok = F.lit(True)
    for c in numbers:
        ok = ok & c.isNotNull() & ~F.isnan(c)

    @F.arrow_udf("struct<gap:double,force:double,limit:double,status:string,stiffness:array<double>>")
    def told(values: pa.Array) -> pa.Array:
        x = _rows(values)
        out = contact_step(x[:, :6], x[:, 6:12], *x[:, 12:].T, tolerance)
        fields = [*(pa.array(out[k]) for k in ("gap", "force", "limit")), pa.array(np.array(STATES, object)[out["status"]]), _lists(out["stiffness"].reshape(len(x), 9))]
        return pa.StructArray.from_arrays(fields, names=["gap", "force", "limit", "status", "stiffness"])

    values = F.when(ok, F.array(*(c.cast("double") for c in numbers))).otherwise(F.array(*[F.lit(0.0)] * len(numbers)))
    own = pairs.withColumn("_told", told(values)).withColumn("_told", F.when(ok, F.col("_told")))
    stiffness = F.when(F.col("_told.status") != "open", F.col("_told.stiffness"))
    return own.select(*pairs.columns, *(F.col(f"_told.{k}").alias(k) for k in ("gap", "force", "limit", "status")), stiffness.alias("stiffness"))


def contact_triplets(pairs: DataFrame) -> DataFrame:
    """(row, col, value) of the contacts' stiffness, summed, of `contact_pairs` rows; a node's degrees of freedom are 3 node to 3 node + 2 (NUM-24).

    A pair whose ends are one node, or null, has none. Each block goes to both ends with its sign; entries are combined before the one
    shuffle, on (row, col), so a node that many pairs share is no burden, and no pair is left out.
    """
    blocks = pairs.where("slave <> master and stiffness is not null").select("slave", "master", F.posexplode("stiffness").alias("at", "v")).where("v <> 0")
    i, j = F.floor(F.col("at") / 3), F.col("at") % 3
    ends = [(a, b, F.col("v") if a == b else -F.col("v")) for a in ("slave", "master") for b in ("slave", "master")]
    spread = F.array(*(F.struct((3 * F.col(a) + i).cast("long").alias("row"), (3 * F.col(b) + j).cast("long").alias("col"), v.alias("value")) for a, b, v in ends))
    return blocks.select(F.inline(spread)).groupBy("row", "col").agg(F.sum("value").alias("value"))


def contact_report(pairs: DataFrame, *keys: str) -> DataFrame:
    """Per key, of `contact_pairs` rows: pairs by status, those of one node, least and greatest gap, greatest force and friction beyond its limit."""
    states = [F.count_if(F.col("status") == s).alias(s) for s in STATES]
    return pairs.groupBy(*keys).agg(F.count("*").alias("pairs"), *states, F.count_if(F.col("slave") == F.col("master")).alias("same"), F.min("gap").alias("least_gap"), F.max("gap").alias("greatest_gap"), F.max("force").alias("greatest_force"))
