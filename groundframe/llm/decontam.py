"""Benchmark decontamination (operator 4): CGK embedding, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, mix, others

#: A document leaks an item if some stretch of its words is within this share of the item's length, in word edits.
EDITS = 0.25
#: Share of the leaks at the greatest distance that some walk should catch, steps of a walk that make a key, and walks at most.
RECALL, SAMPLES, WALKS = 0.99, 2, 64
#: Items of more words are not simulated: their walks fall short of RECALL, and their windows are all verified.
LONG = 256
#: Words of an item's part that must occur unedited, at most.
GRAM = 3
#: Words of the benchmark that one pass over the documents holds; larger benchmarks take several passes.
BLOCK_WORDS = 2_000_000
#: Words walked at a time.
PIECE = 1 << 16
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) else b for b in range(256))
LEAK = "item long, distance int, start int, end int"


def words_of(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words: A-Z lower-cased, ASCII marks and white space as gaps."""
    words = (text or "").encode().translate(_TABLE).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def edits_of(n: int) -> int:
    """Word edits that an item of n words may have."""
    return int(EDITS * n)


def parts_of(n: int) -> list[int]:
    """Where an item's parts begin: one more than it may have edits, so that one of them is without any."""
    k = edits_of(n) + 1
    return [n * i // k for i in range(k + 1)]


def grams_of(words: np.ndarray, g: int) -> np.ndarray:
    """Hashes of every g words in a row."""
    n = max(0, len(words) - g + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(g):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return out


@lru_cache(maxsize=4096)
def sampled_steps(n: int) -> np.ndarray:
    """(WALKS, SAMPLES) steps of each walk whose symbols make the key of a window of n words."""
    rng = np.random.default_rng((5, n))
    steps = max(1, 3 * n // 2)
    return np.sort(np.stack([rng.choice(steps, min(SAMPLES, steps), replace=False) for _ in range(WALKS)]), 1)


def walk_keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, walks: int) -> np.ndarray:
    """(windows, walks) LSH keys of windows [start, end) of `words`, for items of `sizes` words.

    A CGK walk emits the word it stands on and goes on by one if a random bit of (step, word) is set, so it emits each
    word about twice; after an edit the walks of two windows soon meet again, so few steps differ where few edits are. A
    key is what a walk emits at its sampled steps; a walk that leaves the window emits zeros.
    """
    kinds, kind = np.unique(sizes, return_inverse=True)
    last = max((int(sampled_steps(int(n))[:walks].max()) for n in kinds), default=0)
    odd = np.random.default_rng(9).integers(0, 1 << 31, (WALKS, 1 << max(8, last.bit_length()))).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    sampled = np.zeros((len(kinds), walks, last + 1), bool)
    for i, n in enumerate(kinds):
        for w, s in enumerate(sampled_steps(int(n))[:walks]):
            sampled[i, w, s] = True
    padded = np.append(words, np.uint64(0))
    none = len(words)
    at = np.repeat(starts.astype(np.int64)[:, None], walks, 1)
    end = ends.astype(np.int64)[:, None]
    key = np.repeat(np.arange(walks, dtype=np.uint64)[None], len(starts), 0)
    for j in range(last + 1):
        word = padded[np.where(at < end, at, none)]
        mine = sampled[kind, :, j]
        if mine.any():
            with np.errstate(over="ignore"):
                new = (key ^ word) * np.uint64(0x9E3779B97F4A7C15)
            key = np.where(mine, new ^ (new >> np.uint64(29)), key)
        bit = (word >> np.uint64(32)).astype(np.uint32) * odd[:walks, j]
        at += bit >> np.uint32(31)
    return key


@lru_cache(maxsize=4096)
def calibrate(n: int, trials: int = 200) -> tuple[int, float]:
    """(walks, recall): as many walks as catch RECALL of simulated leaks of an n-word item at the greatest distance.

    Random words, an edit in every part but one (of which a third each change, add and drop a word), and the windows that
    `Items.hits` places by the part without. With WALKS walks the recall may stay below; `Items` then does without them.
    """
    rng = np.random.default_rng((3, n))
    e = edits_of(n)
    if not e:
        return 1, 1.0
    items = mix(rng.integers(1, 1 << 62, (trials, n)).astype(np.uint64))
    own = walk_keys(items.ravel(), np.arange(trials) * n, np.arange(1, trials + 1) * n, np.full(trials, n), WALKS)
    texts, starts, item = [], [], []
    base, at = 0, parts_of(n)
    for k in range(trials):
        own_words, words, whole = items[k].tolist(), [], int(rng.integers(e + 1))
        for j, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            part = own_words[a:b]
            if j == whole:
                begin = len(words) - a  # where this part says that the item begins
            else:
                x, kind = int(rng.integers(len(part))), int(rng.integers(3))
                part[x : x + (kind != 1)] = [int(rng.integers(1, 1 << 62))] * (kind != 2)
            words += part
        fill = rng.integers(1, 1 << 62, 2 * n + 2).tolist()
        texts += fill[: n + 1] + words + fill[n + 1 :]
        for s in shifts_of(n):
            starts.append(base + n + 1 + begin + s)
            item.append(k)
        base += len(words) + 2 * n + 2
    starts, item = np.array(starts), np.array(item)
    keys = walk_keys(np.array(texts, np.uint64), starts, starts + n, np.full(len(starts), n), WALKS)
    hit = np.zeros((trials, WALKS), bool)
    np.logical_or.at(hit, item, keys == own[item])
    share = np.logical_or.accumulate(hit, 1).mean(0)
    enough = np.nonzero(share >= RECALL)[0]
    walks = int(enough[0]) + 1 if len(enough) else WALKS
    return walks, float(share[walks - 1])


def shifts_of(n: int) -> list[int]:
    """Where windows begin, from the place that an unedited part gives an item: up to its edits before and behind."""
    e = edits_of(n)
    return list(range(-e, e + 1, max(1, e // 3)))


def best_match(item: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """(edit distance, end) of the stretch of `part` nearest to `item`; the first such end."""
    cost = np.zeros(len(part) + 1, np.int32)
    ramp = np.arange(len(part) + 1, dtype=np.int32)
    for i, w in enumerate(item, 1):
        new = np.empty_like(cost)
        new[0] = i
        np.minimum(cost[:-1] + (part != w), cost[1:] + 1, out=new[1:])
        cost = np.minimum.accumulate(new - ramp) + ramp
    end = int(cost.argmin())
    return int(cost[end]), end


class Items:
    """A block of benchmark items: their words, their windows' keys, and an index of their parts' first words."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words = [], []
        for i, t in rows:
            w = words_of(t)
            if len(w):
                self.ids.append(i)
                self.words.append(w)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.array([edits_of(n) for n in self.sizes.tolist()], np.int64)
        told = [calibrate(n) if n <= LONG else (WALKS, 0.0) for n in self.sizes.tolist()]
        self.whole = np.array([recall < RECALL for _, recall in told], bool)  # walks would lose too many: every window placed is verified
        self.walks = np.array([1 if recall < RECALL else walks for walks, recall in told], np.int64)
        self.most = int(self.walks.max()) if len(self.walks) else 0
        flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        ends = np.cumsum(self.sizes)
        self.own = walk_keys(flat, ends - self.sizes, ends, self.sizes, self.most) if self.words else np.zeros((0, 0), np.uint64)
        found: dict[int, list] = {}
        for k, w in enumerate(self.words):
            at = parts_of(len(w))
            for a, b in zip(at, at[1:], strict=False):
                g = min(GRAM, b - a)
                found.setdefault(g, []).append((int(grams_of(w[a : a + g], g)[0]), k, a))
        self.grams = {}
        for g, rows_ in found.items():
            key = np.array([r[0] for r in rows_], np.uint64)
            order = np.argsort(key, kind="stable")
            item, place = np.array([r[1] for r in rows_])[order], np.array([r[2] for r in rows_])[order]
            seen = np.zeros(1 << 20, bool)
            seen[key >> np.uint64(44)] = True
            self.grams[g] = key[order], item, place, seen

    def starts(self, words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, place) where parts of items occur in `words` (texts parted by gaps, which begin at `begin`): the
        place where the item would begin, each once. Within EDITS one part of an item is whole, so nothing is lost here."""
        texts, items, places = [], [], []
        for g, (keys, item, place, seen) in self.grams.items():
            h = grams_of(words, g)
            some = np.nonzero(seen[h >> np.uint64(44)])[0]
            lo, hi = np.searchsorted(keys, h[some]), np.searchsorted(keys, h[some], side="right")
            n = hi - lo
            at = np.repeat(some, n)
            k = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)
            texts.append(np.searchsorted(begin, at, side="right") - 1)
            items.append(item[k])
            places.append(at - place[k])
        if not texts:
            z = np.zeros(0, np.int64)
            return z, z, z
        found = np.unique(np.stack([np.concatenate(x).astype(np.int64) for x in (texts, items, places)], 1), axis=0)
        t, k, at = found.T
        # an item that may have no edit is found whole: its first place in a text is as good as any
        first = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]) if len(t) else np.zeros(0, bool)
        keep = (self.edits[k] > 0) | first if len(k) else first
        return t[keep], k[keep], at[keep]

    def hits(self, words: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each text (`sizes` words from `begin` on), (item, place in it): windows of the item's size that agree with it in the key of some walk.

        For sizes at which WALKS walks fall short of RECALL, all windows that an unedited part places.
        """
        out: list[list[tuple[int, int]]] = [[] for _ in begin]
        t, k, at = self.starts(words, begin)
        every = self.whole[k]
        for x, item, place in zip(t[every].tolist(), k[every].tolist(), np.maximum(at - begin[t], 0)[every].tolist(), strict=True):
            out[x].append((item, place))
        t, k, at = t[~every], k[~every], at[~every]
        near = {int(n): shifts_of(int(n)) for n in np.unique(self.sizes[k])}
        for s in range(0, len(t), 2_000):
            tt, kk, aa = t[s : s + 2_000], k[s : s + 2_000], at[s : s + 2_000]
            shifts = [near[int(n)] for n in self.sizes[kk]]
            many = np.array([len(x) for x in shifts])
            owner = np.repeat(np.arange(len(tt)), many)
            low, high = begin[tt][owner], (begin + sizes)[tt][owner]
            start = np.clip(aa[owner] + np.concatenate(shifts), low, high)
            n = self.sizes[kk][owner]
            keys = walk_keys(words, start, np.minimum(start + n, high), n, int(self.walks[kk].max()))
            same = keys == self.own[kk[owner], : keys.shape[1]]
            same &= np.arange(keys.shape[1]) < self.walks[kk][owner][:, None]
            for x in np.nonzero(same.any(1))[0].tolist():
                out[int(tt[owner[x]])].append((int(kk[owner[x]]), int(start[x] - low[x])))
        return [sorted(set(x)) for x in out]

    def leaks(self, words: np.ndarray, hits: list[tuple[int, int]]) -> list[dict]:
        """For each item hit in a document of these words, its nearest stretch, if within EDITS of its length."""
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, int] = {}
        for k, at in hits:  # by item, then place: places close together see the same stretch
            w = self.words[k]
            n, most = len(w), int(EDITS * len(w))
            if k in best and best[k][0] == 0 or at <= tried.get(k, -1 << 60) + most // 2 and k in tried:
                continue
            tried[k] = at
            lo, hi = max(0, at - 2 * most - 1), min(len(words), at + n + 2 * most + 1)
            part = words[lo:hi]
            if np.isin(w, part).sum() < n - most:  # an edit takes one of the item's words away at most
                continue
            d, end = best_match(w, part)
            if d <= most and (k not in best or d < best[k][0]):
                start = end - best_match(w[::-1], part[:end][::-1])[1]
                best[k] = (d, lo + start, lo + end)
        return [{"item": self.ids[k], "distance": d, "start": a, "end": b} for k, (d, a, b) in sorted(best.items())]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about BLOCK_WORDS words, brought to the driver one partition at a time."""
    block, n = [], 0
    for i, t in items.toLocalIterator():
        if i is not None and t is not None:
            block.append((i, t))
            n += len(t) // 4
        if n >= BLOCK_WORDS:
            yield block
            block, n = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", col: str = "leaks") -> DataFrame:
    """`docs` with `col`: array<struct<item, distance, start, end>>, one for each benchmark item that the text leaks.

    A text leaks an item if a stretch of its words [start, end) is within EDITS of the item's word count in word edits;
    the nearest stretch is given. Windows of the item's size are embedded by CGK walks, and those that agree with the item
    in the sampled steps of some walk are verified by the exact edit distance. How many walks an item of a size takes follows
    from RECALL by simulated leaks at the greatest distance; for sizes where WALKS of them fall short, every window is verified. Windows are placed where a part of the item stands unedited
    (an item has one part more than it may have edits), so no leak lacks its window. An unedited item is always found.
    Null, empty and wordless texts leak nothing; nor do items with a null id or text, or without words. Rows are
    independent, so repeated rows and extra columns stay (a column named `col` is replaced). The benchmark is
    broadcast in blocks of bounded size, one pass over the documents for each, and dropped after it.
    """
    spark = docs.sparkSession
    (more,) = fresh(docs, "leaks_more")
    out, held = docs.select(*others(docs, col)).withColumn(more, F.array().cast(f"array<struct<{LEAK}>>")), None
    for block in _blocks(items.select(F.col(item_id).cast("long"), F.col(item_text))):
        if held is not None:  # an earlier block's pass is written before the next one's
            out = cut(out)
            held.unpersist()
        held = spark.sparkContext.broadcast(Items(block))
        out = out.withColumn(more, F.concat(more, _leaks_in(held)(F.col(text_col))))
    return out.withColumnRenamed(more, col)


def _leaks_in(shared):
    @F.pandas_udf(f"array<struct<{LEAK}>>")
    def leaks(texts: pd.Series) -> pd.Series:
        items, out = shared.value, []
        group: list[np.ndarray] = []

        def flush() -> None:
            gap = np.zeros(GRAM, np.uint64)  # no part of an item reaches from one document into the next
            sizes = np.array([len(w) for w in group], np.int64)
            begin = np.cumsum(sizes + GRAM) - sizes - GRAM
            if group:
                hits = items.hits(np.concatenate([x for w in group for x in (w, gap)]), begin, sizes)
                out.extend(items.leaks(w, h) if h else [] for w, h in zip(group, hits, strict=True))
            group.clear()

        held = 0
        for t in texts:
            group.append(words_of(t))
            held += len(group[-1])
            if held >= PIECE:
                flush()
                held = 0
        flush()
        return pd.Series(out, dtype=object)

    return leaks


def decontaminate(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """`docs` without the rows that leak an item (see find_leaks)."""
    (col,) = fresh(docs, "leaks")
    return find_leaks(docs, items, col=col, **names).where(F.size(col) == 0).drop(col)
