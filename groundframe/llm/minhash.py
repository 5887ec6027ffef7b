"""MinHash near-dedup (operator 8): SuperMinHash signatures, banding, exact verification, grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, mix, odd_ids, unique_key

#: Words of a shingle; slots of a signature; rows of a band. At a similarity of 0.75, 32 bands of 4 miss 5 pairs in a million.
WORDS, SLOTS, ROWS = 5, 128, 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Rounds of comparisons with one centre a bucket, before the pairs that are left.
ROUNDS = 2
#: Places of a set's bitmap.
BITS = 1 << 13
#: Elements that are hashed at a time, which bounds the permutations held.
ELEMENTS = 200_000
_ODD = mix(np.arange(1, 16)) | np.uint64(1)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words: A-Z lower-cased, separated by ASCII white space (as bytes.split has it)."""
    words = text.encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's `words`-word shingles; of its whole word sequence if that is shorter."""
    h = word_hashes(text or "")
    n = len(h)
    if not n:
        return h
    k = min(words, n)
    with np.errstate(over="ignore"):
        s = h[: n - k + 1] * _ODD[0]
        for i in range(1, k):
            s = s + h[i : n - k + 1 + i] * _ODD[i]
        return np.unique(mix(s + np.uint64(k)))


def super_min_hash(elements: np.ndarray, doc: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """(docs, slots) signatures of the sets doc[i] -> elements[i], every set with one element at least.

    Each element has a random permutation of the slots, drawn one rank at a time; at rank j it offers its
    slot the value j + u, u uniform in [0, 1). All ranks of an element come from one stream, so slots are
    correlated and the variance is below MinHash's. A set stops at the first rank that no slot can still
    gain from: once every slot's value is below j + 1.
    """
    sig = np.full(docs * slots, np.inf)
    live, perm, base = elements, None, doc * slots
    for j in range(slots):
        with np.errstate(over="ignore"):
            x = mix(live + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15))
        u = (x >> np.uint64(11)).astype(np.float64) / (1 << 53)
        k = j + ((x & np.uint64(0x7FF)) * np.uint64(slots - j) >> np.uint64(11)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            own = np.arange(len(live))
            slot = perm[own, k].astype(np.int64)
            perm[own, k] = perm[:, j]
        np.minimum.at(sig, base + slot, u + j)
        open_docs = sig.reshape(docs, slots).max(1) >= j + 1
        still = open_docs[base // slots]
        if not still.any():
            break
        if perm is None:
            k, live, base = k[still], live[still], base[still]
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(live), 1))
            perm[np.arange(len(live)), k] = 0
        elif not still.all():
            live, base, perm = live[still], base[still], perm[still]
    return sig.reshape(docs, slots)


def bands_of(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(docs, bands) 64-bit hashes of `rows` neighbouring slots."""
    parts = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), -1, rows)
    with np.errstate(over="ignore"):
        h = np.zeros(parts.shape[:2], np.uint64)
        for r in range(rows):
            h = mix(h * _ODD[0] + parts[:, :, r] * _ODD[r + 1])
    return h.astype(np.int64)


def sketches_of(sig: np.ndarray) -> np.ndarray:
    """(docs, slots / 16) integers of four bits for every slot."""
    with np.errstate(over="ignore"):
        four = mix(np.ascontiguousarray(sig).view(np.uint64).ravel()).reshape(len(sig), -1, 16) & np.uint64(15)
    return (four << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).astype(np.int64)


def _differing(a: str, b: str) -> Column:
    """Slots in which two sketches differ."""
    total = F.lit(0)
    for k in range(SLOTS // 16):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(x)
    return total


def _most_differing() -> int:
    """What a pair at the threshold stays below in all but one of a million cases (five standard deviations)."""
    p = (1 - PERCENT / 100) * 15 / 16
    return int(SLOTS * p + 5 * (SLOTS * p * (1 - p)) ** 0.5)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, text) → (id, n, d1, d2, bands, sketch): the set's size and 128-bit digest, its signature's bands and sketch."""
    for b in batches:
        rows = list(zip(b["id"], b["text"], strict=True))
        i = 0
        while i < len(rows):
            sets, ids, n = [], [], 0
            while i < len(rows) and n < ELEMENTS:
                sets.append(shingles(rows[i][1]))
                ids.append(rows[i][0])
                n += len(sets[-1])
                i += 1
            full = [k for k, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            if full:
                doc = np.repeat(np.arange(len(full)), [len(sets[k]) for k in full])
                sig = super_min_hash(np.concatenate([sets[k] for k in full]), doc, len(full))
                for k, h, x in zip(full, bands_of(sig), sketches_of(sig), strict=True):
                    bands[k], sketch[k] = h, x
            d = [_digest(s.tobytes()) for s in sets]
            yield pd.DataFrame({"id": pd.array(ids, "Int64"), "n": [len(s) for s in sets], "d1": [x[0] for x in d], "d2": [x[1] for x in d], "bands": bands, "sketch": sketch})


def _digest(packed: bytes) -> tuple[int, int]:
    d = np.array(divmod(xxhash.xxh3_128_intdigest(packed), 1 << 64), np.uint64).astype(np.int64)
    return int(d[0]), int(d[1])


@F.pandas_udf(T.StructType([T.StructField("set", T.BinaryType()), T.StructField("bits", T.ArrayType(T.LongType()))]))
def shingle_set(texts: pd.Series) -> pd.DataFrame:
    """A text's set, packed, with a bitmap of its members (BITS places by hash)."""
    sets, bits = [shingles(t) for t in texts], []
    for s in sets:
        b = np.zeros(BITS, np.uint8)
        b[s >> np.uint64(64 - BITS.bit_length() + 1)] = 1
        bits.append(np.packbits(b).view(np.int64))
    return pd.DataFrame({"set": [s.tobytes() for s in sets], "bits": bits})


def _may_link() -> Column:
    """False only for pairs that bitmaps prove apart: a place that one set fills and the other doesn't is a member less in common."""
    missing = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, n: s + n)
    both = F.least(F.col("size") - missing("bits", "bits_2"), F.col("size_2") - missing("bits_2", "bits"))
    return both * (100 + PERCENT) >= (F.col("size") + F.col("size_2")) * PERCENT


@F.pandas_udf(T.DoubleType())
def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact similarity of two packed sets."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.sort(np.concatenate([x, y]), kind="stable")
        shared = int((both[1:] == both[:-1]).sum())
        out.append(shared / (len(x) + len(y) - shared))
    return pd.Series(out, dtype=float)


def linked(sim: Column) -> Column:
    return sim >= PERCENT / 100


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) distinct → (a, b, sim) by the full sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
    return cut(pairs.join(right, "b").join(left, "a").select("a", "b", jaccard("set_a", "set_b").alias("sim")))


def _labels(links: DataFrame) -> DataFrame:
    """(node, root): for linked nodes, the least node one or two links away. Finer than components, and two shuffles."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    return low.join(low.select(F.col("node").alias("root"), F.col("root").alias("up")), "root").select("node", F.col("up").alias("root"))


def _links(cand: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Components (node, root) of the links among representatives that share a bucket of `cand` (band, h, rep).

    In each of ROUNDS rounds, every member of a bucket is compared with one centre: a linear number of pairs. What is
    left is members of a bucket in different components. Of these, pairs are compared that their set sizes allow to
    link, whose signatures differ in no more slots than a link's do, and that the triangle inequality doesn't rule out
    by their distances from the last centre; each pair once, in the first band it shares. So large groups of copies are
    never expanded into all pairs, and no bucket is capped.
    """
    tested = None
    for turn in range(ROUNDS + 1):
        if tested is None:
            now = cand.withColumn("root", F.col("rep"))
        else:
            found = tested.where(linked(F.col("sim"))).select("a", "b")
            roots = _labels(found) if turn < ROUNDS else components(found)
            now = cand.join(roots, F.col("rep") == F.col("node"), "left").select("band", "h", "rep", F.coalesce("root", "rep").alias("root"))
        last = min(turn, ROUNDS - 1)  # what is left keeps the last round's centre
        order = F.struct(F.xxhash64("rep", F.lit(last)) if last else F.col("rep"), "rep")
        spread = now.groupBy("band", "h").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by("rep", order).alias("centre")
        ).where("lo <> hi")
        now = now.join(spread, ["band", "h"])
        if turn == ROUNDS:
            break
        pairs = now.where("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        new = _verify(pairs, sets)
        tested = new if tested is None else tested.union(new)
    sim = tested.select(F.col("a").alias("rep"), F.col("b").alias("centre"), "sim").union(tested.select("b", "a", "sim"))
    d = F.when(F.col("rep") == F.col("centre"), 0.0).otherwise(1 - F.col("sim"))
    far = now.join(sim, ["rep", "centre"], "left").join(classes.select("rep", "size", "bands", "sketch"), "rep").join(sets.select("rep", "bits"), "rep")
    far = cut(far.select("band", "h", "rep", "root", d.alias("d"), "size", "bands", "sketch", "bits"))
    odd = far.where(F.coalesce(F.col("d"), F.lit(1.0)) > 1 - PERCENT / 100)
    other = far.select(*(F.col(c).alias(f"{c}_2") for c in far.columns))
    metric = F.coalesce(F.abs(F.col("d") - F.col("d_2")) <= 1 - PERCENT / 100 + 1e-9, F.lit(True))
    sizes = F.least("size", "size_2") * 100 >= F.greatest("size", "size_2") * PERCENT
    before = F.exists(F.zip_with(F.slice("bands", 1, F.col("band")), F.slice("bands_2", 1, F.col("band")), lambda x, y: x == y), lambda x: x)
    both_odd = F.coalesce(F.col("d_2"), F.lit(1.0)) > 1 - PERCENT / 100
    once = ~both_odd | (F.col("rep") < F.col("rep_2"))
    on = (F.col("band") == F.col("band_2")) & (F.col("h") == F.col("h_2")) & (F.col("root") != F.col("root_2")) & once & sizes & metric
    on = on & (_differing("sketch", "sketch_2") <= _most_differing()) & ~F.when(F.col("band") > 0, before).otherwise(F.lit(False))
    on = on & _may_link()
    pairs = odd.join(other, on).select(F.least("rep", "rep_2").alias("a"), F.greatest("rep", "rep_2").alias("b")).distinct()
    new = _verify(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), sets).where(linked(F.col("sim")))
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new.select("a", "b")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `id_col`, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and split at ASCII white space; a text's set is its distinct five-word shingles,
    or its whole word sequence if shorter. Two texts link if 100 * intersection >= 75 * union, confirmed on
    their full sets; component_id is the smallest id reachable. Texts with equal sets are one class from the
    start. A null, empty or blank text has an empty set: it links with nothing and is kept. Rows that agree in id and
    text are one document; rows that share an id only are documents of their own, each in its own component. A null id
    links like any other but is never the smallest: where no row of a component has an id, component_id is null and
    the rows that agree with one of them in text are kept; elsewhere a row with a null id isn't kept.
    """
    if not odd_ids(docs, id_col):
        own = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
        out = _grouped(own)
        return out.select(F.col("key").alias(id_col), "n_shingles", F.col("root").alias("component_id"), (F.col("key") == F.col("root")).alias("kept"))
    keyed = cut(unique_key(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", "key"))
    out = _grouped(keyed.select("key", "text").dropDuplicates(["key"]))
    names = keyed.select("key", "id").dropDuplicates(["key"])  # keys are ordered like the ids, null ones last
    out = out.join(names.select(F.col("key").alias("root"), F.col("id").alias("component_id")), "root")
    out = keyed.select("key", "id").join(out, "key")
    kept = F.when(F.col("component_id").isNull(), F.col("key") == F.col("root")).otherwise(F.col("id").eqNullSafe(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def _grouped(own: DataFrame) -> DataFrame:
    """(key, text), keys unique and not null → (key, n_shingles, root): root the smallest key reachable."""
    own = own.select(F.col("key").alias("id"), "text")
    signed = cut(own.mapInPandas(_signed, "id long, n long, d1 long, d2 long, bands array<long>, sketch array<long>"))
    full = signed.where("n > 0")
    classes = cut(full.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.min_by(F.struct(F.col("n").alias("size"), "bands", "sketch"), "id").alias("own")).select("d1", "d2", "rep", "own.*"))
    rows = classes.select("rep", F.posexplode("bands").alias("band", "h"))
    shared = rows.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    cand = cut(rows.join(shared, ["band", "h"]))
    reps = cand.select("rep").distinct()
    texts = own.join(reps, F.col("id") == F.col("rep"), "left_semi")
    sets = texts.select(F.col("id").alias("rep"), shingle_set("text").alias("s")).select("rep", "s.set", "s.bits")
    groups = _links(cand, classes, cut(sets))
    out = signed.join(classes.select("d1", "d2", "rep"), ["d1", "d2"], "left")
    out = out.join(groups, F.col("rep") == F.col("node"), "left")
    root = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("root", "rep"))
    return out.select(F.col("id").alias("key"), F.col("n").alias("n_shingles"), root.alias("root"))
