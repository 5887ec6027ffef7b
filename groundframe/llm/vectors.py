"""Embedding near-dedup (operator 9): collision counting over sorted one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut

COSINE = 0.98
#: Counting projections; tables of cells, and the chance that a pair at the threshold may be missed by all tables.
PROJECTIONS, MISS = 24, 1e-6
#: Width of a cell along one projection, in standard deviations of a random unit vector's; vectors a cell aims at.
CELL, AIM = 2.5, 64
#: Blocks that are compared hold about this many vectors at most, and small cells share a task up to about PACK of them.
BLOCK, PACK = 4_096, 512


@lru_cache(maxsize=8)
def directions(dim: int, n: int, seed: int) -> np.ndarray:
    """(dim, n) random directions scaled so that a random unit vector's projections have unit variance."""
    a = np.random.default_rng(seed).normal(size=(dim, n))
    return a / np.linalg.norm(a, axis=0) * math.sqrt(dim)


def near_sigma(dim: int, cosine: float) -> float:
    """Standard deviation of the difference of two unit vectors' projections, at the threshold."""
    return math.sqrt(2 - 2 * cosine)


def same_cell(sigma: float, width: float) -> float:
    """Chance that values whose difference is normal fall into one cell of a randomly shifted grid."""
    z = np.linspace(-6, 6, 4001)
    p = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return float((np.clip(1 - np.abs(z) * sigma / width, 0, None) * p).sum() * (z[1] - z[0]))


@lru_cache(maxsize=8)
def calibrate(sigma: float, projections: int, recall: float = 0.9999) -> tuple[float, int]:
    """(half-width of a window, least count): the window takes a near pair's projection in 19 cases of 20, and the
    count is the largest that a near pair reaches with chance `recall` (binomial)."""
    half, p = 1.96 * sigma, 0.95
    tail, k = 1.0, 0
    while True:
        below = sum(math.comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(k + 1))
        if 1 - below < recall:
            return half, k
        k += 1


def plan(n: int, dim: int, cosine: float) -> tuple[int, int]:
    """(projections a cell's key takes, tables) for `n` vectors of a label: far pairs share a key seldom enough that a
    key holds about AIM vectors, and near pairs miss every table with chance MISS."""
    far, near = same_cell(math.sqrt(2), CELL), same_cell(near_sigma(dim, cosine), CELL)
    keys = max(1, math.ceil(math.log(max(n / AIM, 1.0 + 1e-9)) / -math.log(far)))
    return keys, max(1, math.ceil(math.log(MISS) / math.log(1 - near**keys)))


def units(vectors) -> np.ndarray:
    """(n, dim) vectors over their lengths, in double precision."""
    v = np.stack([np.asarray(x, np.float64) for x in vectors])
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def usable(v: Column) -> Column:
    """Not null, empty or zero, and without null or non-finite parts."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(v, odd) & F.exists(v, lambda x: x != 0), F.lit(False))


def _cells(x: np.ndarray, keys: int, tables: int) -> np.ndarray:
    """(n, tables) 64-bit keys of unit vectors' cells."""
    dim = x.shape[1]
    shift = np.random.default_rng(11).uniform(0, CELL, keys * tables)
    cell = np.floor((x @ directions(dim, keys * tables, 5) + shift) / CELL).astype(np.int64).reshape(len(x), tables, keys)
    out = np.zeros((len(x), tables), np.int64)
    with np.errstate(over="ignore"):
        for k in range(keys):
            out = (out ^ cell[:, :, k]) * np.int64(0x100000001B3) + np.int64(k + 1)
    return out


def _compare(xa: np.ndarray, xb: np.ndarray | None, table: int, keys: int, tables: int, cosine: float):
    """Links between two blocks of unit vectors of one cell (or within one): indices (i, j).

    Both blocks are sorted along the first counting projection, where each vector's window gives a range of
    candidates; those are counted over the windows of all projections. Pairs that reach the calibrated count
    are verified by cosine in double precision. A pair that shares an earlier table's cell is left to it.
    """
    within, xb = xb is None, xa if xb is None else xb
    dim = xa.shape[1]
    half, least = calibrate(near_sigma(dim, cosine), PROJECTIONS)
    proj = directions(dim, PROJECTIONS, 3)
    pa, pb = xa @ proj, xb @ proj
    oa, ob = np.argsort(pa[:, 0], kind="stable"), np.argsort(pb[:, 0], kind="stable")
    # unit vectors within the threshold cannot lie further apart than this along any projection
    reach = near_sigma(dim, cosine) * math.sqrt(dim) + 1e-9
    sa, sb = pa[oa].astype(np.float32), pb[ob].astype(np.float32)
    ca, cb = _cells(xa[oa], keys, tables)[:, :table], _cells(xb[ob], keys, tables)[:, :table]
    found = []
    for s in range(0, len(sa), 256):
        part = sa[s : s + 256]
        lo, hi = np.searchsorted(sb[:, 0], [part[0, 0] - reach, part[-1, 0] + reach])
        if lo == hi:
            continue
        count = np.zeros((len(part), hi - lo), np.int8)
        for p in range(PROJECTIONS):
            count += np.abs(part[:, p, None] - sb[None, lo:hi, p]) <= half
        i, j = np.nonzero(count >= least)
        i, j = i + s, j + lo
        if within:
            i, j = i[i < j], j[i < j]
        for t in range(0, len(i), 65_536):
            k, m = i[t : t + 65_536], j[t : t + 65_536]
            if table:
                new = ~(ca[k] == cb[m]).any(1)
                k, m = k[new], m[new]
            ok = (xa[oa[k]] * xb[ob[m]]).sum(1) >= cosine
            found.append((oa[k[ok]], ob[m[ok]]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that connect what all the given ones connect, at most n - 1."""
    root, out = list(range(n)), []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = a, b
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def near_vectors(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of `df`: `id_col`, n_links, component_id, kept.

    Vectors of equal, non-null labels and equal length link at a cosine of `cosine` or more, in double precision.
    n_links counts the rows linked to directly (copies included); component_id is the smallest id reachable.
    Vectors that are null, empty, zero, or hold null or non-finite parts link with nothing, nor do null labels.
    Equal vectors of a label are one class, which counts its rows. Null ids are counted as links but are nobody's
    smallest id: their component is null unless linked, and such a row is kept only then. Rows that repeat an id
    stay separate rows of one component.

    Every class goes into one cell in each of several tables, a cell being the grid place of a few sorted
    projections; tables and key sizes follow from the recall wanted. Inside a cell, blocks of bounded size are
    compared pair of blocks by pair of blocks, so that a cell of a third of all rows is spread over many tasks and
    no pair becomes a row: a block pair returns each vector's number of links and a spanning forest of them.
    """
    own = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(label_col)).alias("l1"), F.xxhash64(F.lit(3), F.col(label_col)).alias("l2"), F.col(vec_col).alias("v"), F.col(label_col).isNotNull().alias("labelled"))
    ok = F.col("labelled") & usable(F.col("v"))
    own = own.withColumns({"ok": ok, "v1": F.xxhash64("v"), "v2": F.xxhash64(F.lit(3), "v")})
    identity = ["l1", "l2", "v1", "v2"]  # label and vector, by 128 bits each
    classes = own.where("ok").groupBy(*identity).agg(F.count("*").alias("rows"), F.min("id").alias("rep"), F.first("v").alias("v"))
    # classes without an id get a negative place of their own, so that they can take part
    classes = cut(classes.withColumns({"node": F.coalesce("rep", -F.abs(F.xxhash64(*identity)) - 1), "dim": F.size("v")}))
    counted = classes.groupBy("l1", "l2", "dim").count().groupBy("dim").agg(F.max("count").alias("most"), F.sum("count").alias("n")).collect()  # one row a dimension
    plans = {r["dim"]: plan(r["most"], r["dim"], cosine) for r in counted}
    packs = max(1, sum(r["n"] * plans[r["dim"]][1] for r in counted) // PACK)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, g in b.groupby("dim"):
                keys, tables = plans[dim]
                for s in range(0, len(g), 1_000):
                    some = g.iloc[s : s + 1_000]
                    cells = _cells(units(some["v"]), keys, tables)
                    for t in range(tables):
                        yield some.assign(t=t, cell=cells[:, t])

    placed = classes.select("node", "l1", "l2", "dim", "rows", "v").mapInPandas(place, f"node long, l1 long, l2 long, dim int, rows long, v {dict(df.dtypes)[vec_col]}, t int, cell long")
    key = ["l1", "l2", "dim", "t", "cell"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    rows = placed.join(sizes, key).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # each block meets itself and every other one once: (i, j), i <= j; cells of one block share packs
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("pack", F.when(F.col("blocks") > 1, F.xxhash64(*key)).otherwise(F.pmod(F.xxhash64(*key), F.lit(packs))))
    rows = rows.select("pack", F.xxhash64(*key).alias("cell"), "dim", "t", "l1", "l2", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "rows", "v")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, dim, t, l1, l2), g in group.groupby(["cell", "dim", "t", "l1", "l2"], sort=False):
            keys, tables = plans[dim]
            if g["i"].iloc[0] == g["j"].iloc[0]:
                i, j = _compare(units(g["v"]), None, t, keys, tables, cosine)
            else:
                first = (g["block"] == g["i"]).to_numpy()
                g, n = pd.concat([g[first], g[~first]]), int(first.sum())
                if n in (0, len(g)):
                    continue
                x = units(g["v"])
                i, j = _compare(x[:n], x[n:], t, keys, tables, cosine)
                j = j + n
            if not len(i):
                continue
            nodes, weight, n = g["node"].to_numpy(), g["rows"].to_numpy(), len(g)
            links = (np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)).astype(np.int64)
            some = np.nonzero(links)[0]
            out.append(pd.DataFrame({"a": nodes[some], "b": pd.array([None] * len(some), "Int64"), "n": links[some]}))
            edges = np.array(_forest(i, j, n))
            out.append(pd.DataFrame({"a": nodes[edges[:, 0]], "b": pd.array(nodes[edges[:, 1]], "Int64"), "n": 0}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []})

    links = cut(rows.groupBy("pack", "i", "j").applyInPandas(compare, "a long, b long, n long"))
    degree = links.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    root = components(links.where("b is not null").select("a", "b"))
    # nodes without an id are below zero: a component's smallest real id is the smallest that is not negative
    names = classes.join(root, "node", "left").select(*identity, "rows", "rep", "node", F.coalesce("root", "node").alias("root"))
    smallest = names.groupBy("root").agg(F.min("rep").alias("component"))
    names = names.join(degree, F.col("node") == F.col("a"), "left").join(smallest, "root")
    names = names.select(*identity, (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    own = own.select("id", *(F.when(F.col("ok"), F.col(c)).alias(c) for c in identity))
    out = own.join(names, identity, "left")
    comp = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept")
    )
