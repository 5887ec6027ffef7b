"""Periodic run detection (operator 13): stretches of words that repeat with a short period, and texts without them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, others

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
#: Grid points probed at once, and words compared at once at most.
BLOCK, CHUNK = 1 << 20, 1 << 16
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def _stop(ids: np.ndarray, p: int, i: int) -> int:
    """First place from i on whose word differs from the one p further (or has none)."""
    end, step = len(ids) - p, 32
    while i < end:
        k = min(i + step, end)
        differ = ids[i:k] != ids[i + p : k + p]
        if differ.any():
            return i + int(differ.argmax())
        i, step = k, min(2 * step, CHUNK)
    return end


def _begin(ids: np.ndarray, p: int, i: int) -> int:
    """The least place from which on all words up to place i equal those p further."""
    step = 32
    while i > 0:
        k = max(i - step, 0)
        differ = ids[k:i] != ids[k + p : i + p]
        if differ.any():
            return i - int(differ[::-1].argmax())
        i, step = k, min(2 * step, CHUNK)
    return 0


def _blocks(n: int, times: int) -> Iterator[np.ndarray]:
    """Periods in ascending order, in blocks of about BLOCK grid points."""
    first, last = 1, n // times
    while first <= last:
        some = np.arange(first, min(last, first + max(1, BLOCK * first // n)) + 1)
        yield some
        first = int(some[-1]) + 1


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs among words given by number, by start, then period.

    For every period p, words at jp and (j+1)p are compared; a run's words equal those p further over at least
    (times - 1) p places, so times - 1 grid points in a row hold inside it. Survivors are extended by comparing
    chunks of the array. Grid points that lie within a run found before, of a period that divides p, are skipped: what
    repeats there repeats with the smaller period. As periods ascend, a stretch that a smaller period has is in `seen`.
    """
    n, out, seen = len(ids), [], set()
    if n < least:
        return out
    cover, until = np.ones(n, np.int32), np.zeros(n, np.int64)  # of the run reaching furthest: period, end

    def inside(at: np.ndarray, p) -> np.ndarray:
        return (p % cover[at] == 0) & (at + (times - 1) * p < until[at])

    for periods in _blocks(n, times):
        points = (n - 1) // periods - (times - 2)
        per = np.repeat(periods, points)
        at = (np.arange(len(per)) - np.repeat(np.cumsum(points) - points, points)) * per
        for c in range(times - 1):
            hold = ids[at + c * per] == ids[at + (c + 1) * per]
            at, per = at[hold], per[hold]
        if out and len(at):
            skip = inside(at, per)
            at, per = at[~skip], per[~skip]
        found = len(out)
        firsts = np.flatnonzero(np.diff(per, prepend=0))
        for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(per)], strict=False):
            p, mine = int(per[a]), at[a:b]
            if len(out) > found:
                mine = mine[~inside(mine, p)]
            i = 0
            while i < len(mine):
                place = int(mine[i])
                start, end = _begin(ids, p, place), _stop(ids, p, place) + p
                if end - start >= max(least, times * p) and (start, end) not in seen:
                    seen.add((start, end))
                    out.append((start, end - start, p))
                    further = until[start:end] < end
                    cover[start:end][further], until[start:end][further] = p, end
                i = int(np.searchsorted(mine, end - p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        gone = np.zeros(len(words) + 1, np.int32)
        for start, length, p in runs:
            gone[start + p] += 1
            gone[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, *, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """`docs` with n_words, runs (start, length, period; by start, then period) and collapsed.

    Words are what ASCII white space separates. A run is a stretch of words with smallest period `period`, at least
    `least` words and `times` periods long, that no neighbouring word extends. `collapsed` is the text less the words that
    a run holds after its first period, joined by one space. A null, empty or blank text has no words, no run and collapses
    to an empty text. Rows are independent: repeated rows, ties and extra columns pass through (columns named as
    the results, in any case, are replaced); an empty table gives an empty one. Each text is worked on in one
    task, in memory in proportion to it and about n log n time.
    """

    @F.arrow_udf("struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ns, starts, lengths, periods, places, kept = [], [], [], [], [0], []
            for text in texts:
                words, number = (text.as_py() or b"").split(), {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
                runs = find_runs(ids, least, times)
                ns.append(len(words))
                for to, values in zip((starts, lengths, periods), zip(*runs, strict=True), strict=False):
                    to.extend(values)
                places.append(len(starts))
                kept.append(_collapsed(words, runs).decode())
            rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], fields=list(RUN))
            lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), rows)
            yield pa.StructArray.from_arrays([pa.array(ns, pa.int64()), lists, pa.array(kept, pa.string())], fields=list(FOUND))

    (own,) = fresh(docs, "found")
    (text,) = named(text_col)
    rest = others(docs, "n_words", "runs", "collapsed")
    return docs.select(*rest, told(text.cast("binary")).alias(own)).select(*rest, *(F.col(f"{own}.{c}").alias(c) for c in ("n_words", "runs", "collapsed")))
