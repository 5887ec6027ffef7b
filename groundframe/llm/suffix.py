"""Suffix-array dedup (operator 10): removes bytes of strings that also start earlier.

Every string of LENGTH bytes is assigned to an anchor: the least hash among the GRAM-byte grams inside it. Equal
strings have equal anchors at equal places, so they can only meet within one anchor's gram; consecutive strings
with the same anchor form a run, about one for 30 bytes of text. Runs are compared instead of strings: first among
themselves in each task, where a hash-compared suffix sort brings equal ones together and their bytes are compared, then
across tasks by 96 bits of hash. Only strings of runs whose gram occurs in different surroundings are compared one by one.
What meets across tasks by these hashes is verified: runs that follow each other are joined to stretches, whose bytes,
here and at the earlier place, must have one SHA-256. Runs that fail are compared by strings, strings that fail by
their bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, mix, others, unique_key

LENGTH, GRAM = 100, 40
ONCE, REPEAT, PART, FIRST, MIXED = range(5)
#: Bytes hashed at a time. Long texts go in segments, which may part a run; that costs comparisons, not results.
SEGMENT = 1 << 17
#: Bytes of text among which a task sorts its runs at a time.
LOCAL = 1 << 23
#: Stretches of one document that are asked for in a row; strings whose bytes are compared at a time.
ASKED, STRINGS = 1 << 14, 1 << 14
_NAMES = ["doc", "p", "n", "other", "op", "d1", "d2"]
_STRETCH = ", ".join(f"{c} long" for c in _NAMES)


@lru_cache(maxsize=4)
def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base, of its inverse, and a table of byte values, modulo 2**64."""
    base = int(mix(np.array([seed + 1]))[0]) | 1
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000))


class Hashed:
    """Prefix polynomial hashes of a buffer: the hash of any substring in constant time."""

    def __init__(self, buf: np.ndarray, seed: int = 1):
        size = 1 << max(17, int(len(buf) + 1).bit_length())
        up, self.down, table = _powers(seed, size)
        self.buf, self.sum = buf, np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(table[buf] * up[: len(buf)], out=self.sum[1:])

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sum[start + length] - self.sum[start]) * self.down[start]

    def common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions of suffixes a and b, up to `limit`, by binary search over hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.array(limit, np.int64)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self(a, mid) == self(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
        """Whether string a (length la) sorts before string b (length lb)."""
        short = np.minimum(la, lb)
        n = self.common(a, b, short)
        last = len(self.buf) - 1
        x, y = self.buf[np.minimum(a + n, last)], self.buf[np.minimum(b + n, last)]
        return np.where(n < short, x < y, la < lb)


def sort_suffixes(h: Hashed, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """An order in which each group (equal neighbours in `group`) stands sorted by string, ties in their given order.

    Bottom-up mergesort over all groups at once: each round, every element of a block finds its place in the
    block beside it by binary search, a step of which compares two suffixes by their common extension.
    """
    n = len(start)
    order = np.arange(n)
    first = np.concatenate([[0], np.nonzero(group[1:] != group[:-1])[0] + 1]) if n else np.zeros(0, int)
    sizes = np.diff(np.concatenate([first, [n]]))
    begin, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    width = 1
    while n and width < sizes.max():
        own = np.nonzero(size > width)[0]  # groups already in one block stay
        at = own - begin[own]
        left = (at // width) % 2 == 0
        base = begin[own] + at // (2 * width) * (2 * width)
        end = begin[own] + size[own]
        lo = np.where(left, np.minimum(base + width, end), base)
        hi = np.where(left, np.minimum(base + 2 * width, end), np.minimum(base + width, end))
        other = lo.copy()
        me = order[own]
        while (open_ := lo < hi).any():
            k = np.nonzero(open_)[0]
            mid = (lo[k] + hi[k]) >> 1
            it, my = order[mid], me[k]
            # a left element goes after right ones that are less; a right element after left ones that are not greater
            after = np.where(
                left[k],
                h.less(start[it], length[it], start[my], length[my]),
                ~h.less(start[my], length[my], start[it], length[it]),
            )
            lo[k], hi[k] = np.where(after, mid + 1, lo[k]), np.where(after, hi[k], mid)
        place = np.where(left, own + lo - other, base + (at % width) + lo - other)
        order = order.copy()
        order[place] = me
        width *= 2
    return order


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of `width` values."""
    done = 1
    out = v
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(v) - width + 1], out[width - done :]) if width > done else out


def runs_of(buf: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, gram hash, place of the anchor) of each run; `doc` numbers the bytes' texts."""
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return none, none, none.astype(np.uint64), none
    h = Hashed(buf)
    g = h(np.arange(len(buf) - GRAM + 1), GRAM)
    g = (g ^ (g >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    wide = LENGTH - GRAM + 1
    least = _least(g, wide)
    p = np.nonzero(doc[: len(least)] == doc[LENGTH - 1 :])[0]
    if not len(p):
        return none, none, none.astype(np.uint64), none
    v = least[p]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (p[1:] != p[:-1] + 1)])
    first = np.nonzero(new)[0]
    n = np.diff(np.concatenate([first, [len(p)]]))
    lo = p[first]
    # the anchor is the leftmost place of the least hash; a run ends where the anchor leaves, even if the gram repeats
    cols = g[lo[:, None] + np.arange(wide)] == v[first][:, None]
    at = lo + cols.argmax(1)
    out_lo, out_n, out_k, out_at = [lo], [n], [v[first]], [at]
    late = np.nonzero(lo + n - 1 > at)[0]
    for r in late:  # rare: repeats of one gram within reach of each other
        q, end, k = int(lo[r]), int(lo[r] + n[r]), v[first[r]]
        out_n[0][r] = at[r] - q + 1
        q = int(at[r]) + 1
        while q < end:
            a = q + int((g[q : q + wide] == k).argmax())
            m = min(a, end - 1) - q + 1
            out_lo.append(np.array([q]))
            out_n.append(np.array([m]))
            out_k.append(np.array([k]))
            out_at.append(np.array([a]))
            q += m
    return tuple(np.concatenate(x) for x in (out_lo, out_n, out_k, out_at))


def _segments(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    """Buffers of about SEGMENT bytes: ((text, offset) of each part, the parts joined)."""
    parts, held, n = [], [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - LENGTH + 1), SEGMENT):
            piece = t[s : s + SEGMENT + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            parts.append((i, s))
            held.append(piece)
            n += len(piece)
            if n >= SEGMENT:
                yield parts, held
                parts, held, n = [], [], 0
    if parts:
        yield parts, held


def _some_bits(h: np.ndarray, bits: int) -> np.ndarray:
    """The upper `bits` bits of 64, the others 0."""
    return h & ~np.uint64((1 << (64 - bits)) - 1)


def _all_runs(texts: list[bytes], bits: int = 64) -> tuple[np.ndarray, ...]:
    """(text, first start, number of starts, gram, context hash) of the runs of all texts."""
    out = []
    for parts, held in _segments(texts):
        buf = np.frombuffer(b"".join(held), np.uint8)
        sizes = np.array([len(x) for x in held])
        begin = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
        lo, n, k, at = runs_of(buf, doc)
        own = doc[lo]
        h = Hashed(buf, 2)
        c = mix(h(lo, n + LENGTH - 1) + (n.astype(np.uint64) << np.uint64(8)) + (at - lo).astype(np.uint64))
        which, off = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        out.append((which[own], lo - begin[own] + off[own], n, k, _some_bits(c, bits)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _local(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """(doc, text) → rows (key, cp, doc, m) of runs after a first comparison among some texts.

    cp holds 32 bits of the context's hash and the first start, m the number of starts and a kind. ONCE: the only run
    of a gram (the key) here; FIRST: the earliest of several with one context; MIXED: a gram with several contexts
    here. These meet by their key; the others have keys of their own. PART: a run of a MIXED gram. REPEAT: a stretch of
    starts that repeat an earlier one here.
    """
    for b in batches:
        texts = [t.encode() for t in b["text"]]
        ids = b["doc"].to_numpy()
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j]) <= LOCAL):
                n += len(texts[j])
                j += 1
            yield _compared(texts[i:j], ids[i:j], bits)
            i = j


def _packed(kind: int, key: np.ndarray, c: np.ndarray | None, doc: np.ndarray, p: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    high = np.zeros(len(p), np.uint64) if c is None else c >> np.uint64(32)
    cp = (high << np.uint64(32)) | p.astype(np.uint64)
    return pd.DataFrame({"key": key.astype(np.int64), "cp": cp.astype(np.int64), "doc": doc, "m": n.astype(np.int64) * 8 + kind})


def _own_key(doc: np.ndarray, p: np.ndarray) -> np.ndarray:
    return mix(mix(doc.astype(np.uint64)) + p.astype(np.uint64))


def _compared(texts: list[bytes], ids: np.ndarray, bits: int) -> pd.DataFrame:
    which, p, n, k, c = _all_runs(texts, bits)
    doc = ids[which] if len(which) else np.zeros(0, np.int64)
    order = np.lexsort((p, doc, k))
    which, p, n, k, c, doc = (x[order] for x in (which, p, n, k, c, doc))
    same = k[1:] == k[:-1]
    again = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(k) else np.zeros(0, bool)
    once = ~again
    rows = [_packed(ONCE, k[once], c[once], doc[once], p[once], n[once])]
    r = np.nonzero(again)[0]
    if len(r):
        which, p, n, k, c, doc = (x[r] for x in (which, p, n, k, c, doc))
        used = np.unique(which)
        sizes = np.array([len(texts[u]) for u in used])
        begin = np.cumsum(sizes) - sizes
        buf = np.frombuffer(b"".join(texts[u] for u in used), np.uint8)
        start, length = begin[np.searchsorted(used, which)] + p, n + LENGTH - 1
        o = sort_suffixes(Hashed(buf, 3), start, length, k)
        p, n, k, c, doc, start, length = (x[o] for x in (p, n, k, c, doc, start, length))
        # neighbours of one gram, length and context are equal strings; the bytes confirm it
        equal = np.concatenate([[False], (k[1:] == k[:-1]) & (length[1:] == length[:-1]) & (c[1:] == c[:-1])])
        for x in np.nonzero(equal)[0]:
            s, t, m = start[x - 1], start[x], length[x]
            equal[x] = buf[s : s + m].tobytes() == buf[t : t + m].tobytes()
        new = np.concatenate([[True], k[1:] != k[:-1]])
        first = np.nonzero(new)[0]
        several = np.repeat(np.add.reduceat((~equal).astype(int), first) > 1, np.diff(np.concatenate([first, [len(k)]])))
        one, mark, part = ~several & ~equal, new & several, several & ~equal
        rows.append(_packed(FIRST, k[one], c[one], doc[one], p[one], n[one]))
        rows.append(_packed(MIXED, k[mark], None, doc[mark], p[mark], n[mark]))
        rows.append(_packed(PART, _own_key(doc[part], p[part]), None, doc[part], p[part], n[part]))
        d, a, m = doc[equal], p[equal], n[equal]
        if len(d):  # stretches that follow each other become one
            o = np.lexsort((a, d))
            d, a, m = d[o], a[o], m[o]
            f = np.nonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] != a[:-1] + m[:-1])]))[0]
            rows.append(_packed(REPEAT, _own_key(d[f], a[f]), None, d[f], a[f], np.add.reduceat(m, f)))
    return pd.concat(rows)


def _flags(stretches: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` places lie in a stretch [a, b); stretches as rows."""
    d = np.zeros(size + 1, np.int32)
    np.add.at(d, np.clip(stretches[:, 0], 0, size), 1)
    np.add.at(d, np.clip(stretches[:, 1], 0, size), -1)
    return np.cumsum(d)[:size] > 0


def _asked_starts(runs: list, size: int) -> np.ndarray:
    return np.nonzero(_flags(np.array([(r["p"], r["p"] + r["n"]) for r in runs], np.int64), size))[0]


def _strings(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """(doc, text, runs [(p, n)]) → strings that still need comparing: rows (h1, hp, doc, n).

    hp holds 32 more bits of the string's hash, and its start. n is 0 for the earliest place of a string among some
    texts; else the row is a stretch of n starts known to be repeats, as their bytes are those of an earlier string here.
    """
    for b in batches:
        for s in range(0, len(b), 2_000):
            some = b.iloc[s : s + 2_000]
            got, held, size = [], [], 0
            for doc, text, runs in zip(some["doc"], some["text"], some["runs"], strict=True):
                data = text.encode()
                p = _asked_starts(runs, len(data))
                for at in range(0, len(data), SEGMENT):
                    q = p[np.searchsorted(p, at) : np.searchsorted(p, at + SEGMENT)]
                    if len(q):
                        buf = np.frombuffer(data[at : at + SEGMENT + LENGTH], np.uint8)
                        h1, h2 = (mix(Hashed(buf, seed)(q - at, LENGTH)) for seed in (4, 5))
                        h2 = h2 >> np.uint64(32) if bits == 64 else np.zeros_like(h2)
                        got.append((np.full(len(q), doc), q, _some_bits(h1, bits), h2, size + q - at))
                        held.append(buf)
                        size += len(buf)
            if not got:
                continue
            doc, p, h1, h2, place = (np.concatenate(x) for x in zip(*got, strict=True))
            o = np.lexsort((p, doc, h2, h1))
            doc, p, h1, h2, place = doc[o], p[o], h1[o], h2[o], place[o]
            again = np.concatenate([[False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])])
            whole = np.lib.stride_tricks.sliding_window_view(np.concatenate(held), LENGTH)
            alike = np.nonzero(again)[0]
            for k in range(0, len(alike), STRINGS):  # one that only has its neighbour's hash goes on by itself
                x = alike[k : k + STRINGS]
                again[x] = (whole[place[x]] == whole[place[x - 1]]).all(1)
            f, d, q = ~again, doc[again], p[again]
            hp = ((h2[f] << np.uint64(32)) | p[f].astype(np.uint64)).astype(np.int64)
            yield pd.DataFrame({"h1": h1[f].astype(np.int64), "hp": hp, "doc": doc[f], "n": 0})
            if len(d):
                o = np.lexsort((q, d))
                d, q = d[o], q[o]
                at = np.nonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (q[1:] != q[:-1] + 1)]))[0]
                n = np.diff(np.concatenate([at, [len(d)]]))
                yield pd.DataFrame({"h1": _own_key(d[at], q[at]).astype(np.int64), "hp": q[at], "doc": d[at], "n": n})


def _bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc, text, runs [(p, n)]) → rows (string, doc, p): the bytes of each string that starts in a run."""
    for b in batches:
        for doc, text, runs in zip(b["doc"], b["text"], b["runs"], strict=True):
            data = text.encode()
            p = _asked_starts(runs, len(data))
            for k in range(0, len(p), STRINGS):
                yield pd.DataFrame({"string": [data[x : x + LENGTH] for x in p[k : k + STRINGS].tolist()], "doc": doc, "p": p[k : k + STRINGS]})


def _digests(batches: Iterator[pa.RecordBatch], join: bool) -> Iterator[pa.RecordBatch]:
    """(doc, text, asked [(p, n, other, op)]) → _STRETCH: 128 bits of the SHA-256 of the bytes that the strings at n starts from p cover.

    With `join`, stretches that follow each other here and in the other document are one.
    """
    for b in batches:
        ids, texts, lists = b.column(0).to_numpy(), b.column(1).cast(pa.large_binary()), b.column(2)
        offsets = lists.offsets.to_numpy()
        row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
        p, n, other, op = (lists.values.field(k).to_numpy()[offsets[0] : offsets[-1]] for k in range(4))
        if join and len(p):
            o = np.lexsort((p, op - p, other, row))
            row, p, n, other, op = row[o], p[o], n[o], other[o], op[o]
            on = (row[1:] == row[:-1]) & (other[1:] == other[:-1]) & (op[1:] - p[1:] == op[:-1] - p[:-1]) & (p[1:] == p[:-1] + n[:-1])
            f = np.nonzero(np.concatenate([[True], ~on]))[0]
            row, p, n, other, op = row[f], p[f], np.add.reduceat(n, f), other[f], op[f]
        held, data, d = -1, memoryview(b""), []
        for r, x, y in zip(row.tolist(), p.tolist(), (p + n - 1 + LENGTH).tolist(), strict=True):
            if r != held:
                held, data = r, memoryview(texts[r].as_buffer())
            d.append(hashlib.sha256(data[x:y]).digest()[:16])
        d = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[row], p, n, other, op, d[:, 0], d[:, 1])], names=_NAMES)


def _verified(claims: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Claims (doc, p, n, other, op) that strings at n starts from p in `doc` equal those from op in `other` →
    (stretches (doc, p, n) of which it is true, stretches of both sides that it may not be true of; None if there are none).

    Only digests move: of each stretch, and of each place in another document that stretches refer to, however many.
    """
    mine = claims.groupBy("doc").agg(F.collect_list(F.struct("p", "n", "other", "op")).alias("asked")).join(texts, "doc")
    mine = cut(mine.select("doc", "text", "asked").mapInArrow(partial(_digests, join=True), _STRETCH))
    asked = mine.select("other", "op", "n").distinct()
    salts = asked.groupBy("other").agg(F.ceil(F.count("*") / ASKED).alias("salts"))
    asked = asked.join(salts, "other").groupBy(F.col("other").alias("doc"), F.pmod(F.xxhash64("op", "n"), "salts"))
    asked = asked.agg(F.collect_list(F.struct(F.col("op").alias("p"), "n", "other", "op")).alias("asked")).join(texts, "doc")
    theirs = asked.select("doc", "text", "asked").mapInArrow(partial(_digests, join=False), _STRETCH)
    place, d = ["other", "op", "n"], ["d1", "d2"]
    both = mine.select(*place, *d).union(theirs.select(*place, *d)).groupBy(*place)
    odd = cut(both.agg(*(f(c).alias(f"{c}_{f.__name__}") for c in d for f in (F.min, F.max))).where("d1_min <> d1_max or d2_min <> d2_max").select(*place))
    if odd.isEmpty():
        return mine.select("doc", "p", "n"), None
    wrong = mine.join(odd, place, "left_semi").select("doc", "p", "n").union(odd.select("other", "op", "n"))
    return mine.join(odd, place, "left_anti").select("doc", "p", "n"), wrong


def _covered(starts: list, size: int) -> np.ndarray:
    """Maximal stretches (k, 2) of bytes covered by strings at starts [(p, n)]."""
    if len(starts) == 0:
        return np.zeros((0, 2), np.int64)
    a = np.array([(r["p"], min(r["p"] + r["n"] - 1 + LENGTH, size)) for r in starts], np.int64)
    a = a[np.argsort(a[:, 0], kind="stable")]
    end = np.maximum.accumulate(a[:, 1])
    first = np.nonzero(np.concatenate([[True], a[1:, 0] > end[:-1]]))[0]
    return np.stack([a[first, 0], end[np.concatenate([first[1:] - 1, [len(a) - 1]])]], 1)


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """`docs` with n_bytes, n_removed, n_spans, removed (array of byte spans) and kept (the remaining bytes).

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller id, or in the same
    document before. Strings are judged on the input. A null or empty text has no bytes. Null ids count as
    the largest. Rows that agree in id and text are one document (each row is returned with its spans); rows
    that share an id only are documents of their own, ordered by a hash of their text. Extra columns stay.
    `bits` (1 to 64) of a hash decide what is compared; the result is the same for any number, and fewer only cost time
    (below 64, strings also go without their second hash).
    """
    made = ["n_bytes", "n_removed", "n_spans", "removed", "kept"]
    docs = docs.select(*others(docs, *made))
    key, held = fresh(docs, "doc", "row")
    keyed = unique_key(docs, id_col, text_col, key)
    rest = others(docs, text_col)
    own = keyed.select(F.col(key).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*rest).alias(held)).where("doc is not null")

    low, high = (lambda c: (F.col(c) if isinstance(c, str) else c).bitwiseAND(F.lit((1 << 32) - 1))), (lambda c: F.shiftright(c, 32))
    texts = own.select("doc", "text")
    rows = texts.mapInPandas(partial(_local, bits=bits), "key long, cp long, doc long, m long")
    kind, n, c = F.col("m").bitwiseAND(F.lit(7)), F.shiftright("m", 3), high("cp")
    run = kind.isin(ONCE, FIRST)
    w = Window.partitionBy("key")
    order = Window.partitionBy("key", c, n, kind == MIXED).orderBy("doc", "cp")
    differ = lambda x: F.coalesce(F.min(F.when(run, x)).over(w) != F.max(F.when(run, x)).over(w), F.lit(False))
    rows = rows.withColumns({
        "several": differ(c) | differ(n) | F.max(kind == MIXED).over(w),
        "turn": F.row_number().over(order), "other": F.first("doc").over(order), "op": low(F.first("cp").over(order)),
    })
    late = run & (F.col("turn") > 1)
    what = F.when(kind.isin(REPEAT, PART), kind).when(late, ONCE).when(run & F.col("several"), PART)
    info = cut(rows.select("doc", low("cp").alias("p"), n.alias("n"), what.alias("what"), *(F.when(late, F.col(x)).alias(x) for x in ("other", "op"))).where("what is not null"))

    stretch = ["doc", "p", "n"]
    same, wrong = _verified(info.where(F.col("what") == ONCE).select(*stretch, "other", "op"), texts)
    marks = info.where(F.col("what") == REPEAT).select(*stretch).union(same)
    todo = info.where(F.col("what") == PART).select(*stretch)
    todo = (todo if wrong is None else todo.union(wrong)).groupBy("doc").agg(F.collect_list(F.struct("p", "n")).alias("runs"))
    strings = texts.join(todo, "doc").select("doc", "text", "runs").mapInPandas(partial(_strings, bits=bits), "h1 long, hp long, doc long, n long")
    order = Window.partitionBy("h1", high("hp")).orderBy("doc", "hp")
    more = strings.withColumns({"turn": F.row_number().over(order), "other": F.first("doc").over(order), "op": low(F.first("hp").over(order))})
    more = cut(more.where("n > 0 or turn > 1").select("doc", low("hp").alias("p"), "n", "other", "op"))
    same, wrong = _verified(more.where("n = 0").select("doc", "p", F.lit(1).cast("long").alias("n"), "other", "op"), texts)
    marks = marks.union(more.where("n > 0").select(*stretch)).union(same)
    if wrong is not None:  # hashes that different strings share
        runs = wrong.groupBy("doc").agg(F.collect_list(F.struct("p", "n")).alias("runs"))
        each = texts.join(runs, "doc").select("doc", "text", "runs").mapInPandas(_bytes, "string binary, doc long, p long")
        turn = F.row_number().over(Window.partitionBy("string").orderBy("doc", "p"))
        marks = marks.union(each.withColumn("turn", turn).where("turn > 1").select("doc", "p", F.lit(1).cast("long")))
    marks = marks.groupBy("doc").agg(F.collect_list(F.struct("p", "n")).alias("marks"))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, removed array<struct<start:long,end:long>>, kept binary")
    def kept(text: pd.Series, marks: pd.Series) -> pd.DataFrame:
        out = []
        for t, m in zip(text, marks, strict=True):
            data = t.encode()
            spans = _covered([] if m is None else m, len(data))
            left = np.concatenate([[0], spans[:, 1]]), np.concatenate([spans[:, 0], [len(data)]])
            rest = b"".join(data[a:b] for a, b in zip(*map(np.ndarray.tolist, left), strict=True))
            out.append((len(data), len(data) - len(rest), len(spans), [{"start": a, "end": b} for a, b in spans.tolist()], rest))
        return pd.DataFrame(out, columns=made)

    out = own.join(marks, "doc", "left").select(held, "text", kept("text", "marks").alias("out"))
    return out.select(f"{held}.*", F.col("text").alias(text_col), "out.*")
