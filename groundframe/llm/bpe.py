"""Byte-level BPE encoding and decoding (operator 1)."""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, others

#: Texts of more code points than this are cut into chunks of as many, each reaching OVERLAP further.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: Code points of text whose pieces are looked up at a time; pieces merged and ids decoded at a time.
GROUP, MERGED, DECODED = 1 << 19, 1 << 14, 1 << 16
#: Bytes of pieces that are merged side by side and kept; more than any rank.
SHORT, _NONE = 64, np.iinfo(np.int32).max


def read_ranks(path: str) -> bytes:
    """A rank file's bytes (one base64 token and its rank a line)."""
    with open(path, "rb") as f:
        return f.read()


def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


class _Tokens:
    """The bytes of all tokens in one array, with each one's place and length; decoding gathers from it."""

    def __init__(self, data: bytes):
        ranks = _ranks(data)
        size = np.array([len(t) for t in ranks], np.int64)
        ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.bytes = np.frombuffer(b"".join(ranks), np.uint8)
        self.size = np.full(ids.max() + 1, -1, np.int64)  # of ids that no token has
        self.start = np.zeros(len(self.size), np.int64)
        self.size[ids], self.start[ids] = size, np.cumsum(size) - size

    def decode(self, packed: bytes) -> bytes:
        ids, out = np.frombuffer(packed, "<u4"), []
        if len(ids) and (ids.max() >= len(self.size) or self.size[ids].min() < 0):
            raise KeyError(next(i for i in ids.tolist() if i >= len(self.size) or self.size[i] < 0))
        for k in range(0, len(ids), DECODED):
            part = ids[k : k + DECODED]
            size = self.size[part]
            ends = np.cumsum(size)
            at = np.repeat(self.start[part] - ends + size, size)
            out.append(self.bytes[at + np.arange(len(at))].tobytes())
        return b"".join(out)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a piece: of all neighbours the pair of the lowest rank, the leftmost of several, becomes one, until no pair has a rank.

    Pairs wait in a heap and parts are linked by their places, so a piece of n bytes takes about n log n steps.
    """
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:  # one of the two has grown or gone since
            continue
        end[i], alive[j] = stop, False
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pairs:
    """The rank of each two tokens that make a third: merges many pieces side by side, one pair of each a step."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        #: Without a token for each byte, parts need not be tokens, and pieces are merged one by one.
        self.whole = bool((self.bytes >= 0).all())
        get, found = ranks.get, {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                if (x := get(t[:k])) is not None and (y := get(t[k:])) is not None:
                    found[x << 32 | y] = r
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k] for k in self.keys.tolist()], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece, none empty; as `merge`."""
        out: list[bytes] = [b""] * len(pieces)
        row, size = np.arange(len(pieces)), np.array([len(p) for p in pieces])
        width = int(size.max())
        held = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < size[:, None], self.bytes[held], -1)  # places past a piece's end hold -1, which no pair has
        rank = np.full((len(pieces), max(1, width - 1)), _NONE, np.int32)
        if width > 1:
            rank[:] = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rank.shape)
        while len(row):
            at = rank.argmin(1)
            low = rank[np.arange(len(row)), at]
            done = low == _NONE
            if done.any():
                packed, n = ids[done].astype("<u4"), ids.shape[1] * 4
                packed = packed.tobytes()
                for k, (i, m) in enumerate(zip(row[done].tolist(), size[done].tolist(), strict=True)):
                    out[i] = packed[k * n : k * n + 4 * m]
                row, size, ids, rank, at, low = (x[~done] for x in (row, size, ids, rank, at, low))
                if not len(row):
                    break
            here, width = np.arange(len(row)), ids.shape[1] - 1
            ids[here, at] = low
            kept = np.ones(ids.shape, bool)
            kept[here, at + 1] = False
            ids = ids[kept].reshape(-1, width)
            if width == 1:
                rank = np.full((len(row), 1), _NONE, np.int32)
            else:
                kept = np.ones(rank.shape, bool)
                kept[here, at] = False
                rank = rank[kept].reshape(-1, width - 1)
                some = at < width - 1
                rank[here[some], at[some]] = self._rank(low[some], ids[here[some], at[some] + 1])
                some = at > 0
                rank[here[some], at[some] - 1] = self._rank(ids[here[some], at[some] - 1], low[some])
            size -= 1
        return out


class _Cache(dict):
    """Ids, packed, of pieces already met; bounded."""

    def __init__(self, ranks: dict[bytes, int], pairs: Pairs):
        super().__init__()
        self.ranks, self.pairs = ranks, pairs

    def __missing__(self, piece: str) -> bytes:
        b = piece.encode()
        own = self.ranks.get(b)
        return struct.pack("<I", own) if own is not None else np.array(merge(b, self.ranks), "<u4").tobytes()

    def _fill(self, pieces: set[str]) -> None:
        """Those of `pieces` not met yet, of SHORT bytes or fewer, by about the same length together."""
        new = sorted((p for p in pieces if p not in self), key=len)
        if len(self) + len(new) > 150_000:
            self.clear()
            new = sorted(pieces, key=len)
        todo: list[tuple[str, bytes]] = []
        for p in new:
            b = p.encode()
            if len(b) > SHORT:
                continue
            if (own := self.ranks.get(b)) is not None:
                self[p] = struct.pack("<I", own)
            elif self.pairs.whole:
                todo.append((p, b))
            else:
                self[p] = self[p]
        for k in range(0, len(todo), MERGED):
            some = todo[k : k + MERGED]
            self.update(zip((p for p, _ in some), self.pairs.merge([b for _, b in some]), strict=True))

    def packed(self, lists: list[list[str]]) -> list[bytes]:
        """The packed ids of each list of pieces; long pieces are merged where they stand."""
        self._fill(set().union(*lists))
        return [b"".join(map(self.__getitem__, x)) for x in lists]


def _cache(data: bytes, pairs: Pairs) -> _Cache:
    """A new one for each task: a worker process that stays keeps nothing of it."""
    return _Cache(_ranks(data), pairs)


def _grouped(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts, in order, in lists of about GROUP code points."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n < GROUP):
            n += len(texts[j] or "")
            j += 1
        yield texts[i:j]
        i = j


def _slices(batches: Iterator[pd.Series], rows: int = 500) -> Iterator[pd.Series]:
    """Batches in slices, so that what is made from one is handed on before the next."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.iloc[i : i + rows]


class Bpe:
    """Encoder and decoder over one rank file, whose bytes and pairs (fixed in size) are broadcast to the executors."""

    def __init__(self, spark, path: str, pattern: str, *, chunk: int = CHUNK, overlap: int = OVERLAP):
        data = read_ranks(path)
        self.data, self.pairs = spark.sparkContext.broadcast(data), spark.sparkContext.broadcast(Pairs(_ranks(data)))
        self.pattern, self.chunk, self.overlap = pattern, chunk, overlap

    def _encode_whole(self, text: Column) -> Column:
        data, pairs, pattern = self.data, self.pairs, self.pattern

        @F.pandas_udf("binary")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            find, ids = regex.compile(pattern).findall, _cache(data.value, pairs.value)
            for texts in _slices(batches):
                out: list[bytes | None] = []
                for some in _grouped(texts.tolist()):
                    packed = ids.packed([find(t or "") for t in some])
                    out += [None if t is None else p for t, p in zip(some, packed, strict=True)]
                yield pd.Series(out, dtype=object)

        return encode(text)

    def _encode_cuts(self, *cols: Column) -> Column:
        data, pairs = self.data, self.pairs

        @F.pandas_udf("binary")
        def encode(text: pd.Series, start: pd.Series, cuts: pd.Series, first: pd.Series, end: pd.Series) -> pd.Series:
            ids, out = _cache(data.value, pairs.value), []
            for t, s, c, a, e in zip(text, start, cuts, first, end, strict=True):
                if pd.isna(a):
                    out.append(b"")
                    continue
                c = c[(c >= a - s) & (c <= (len(t) if pd.isna(e) else e - s))].tolist()
                out += ids.packed([[t[x:y] for x, y in zip(c, c[1:], strict=False)]])
            return pd.Series(out, dtype=object)

        return encode(*cols)

    def _encode_long(self, texts: DataFrame) -> DataFrame:
        """(key, text), keys unique → (key, ids); ids null where neighbouring chunks never resynchronise.

        A match of the pattern depends on the text from its start on alone, so where two chunks both begin a
        match, all later matches agree; only the last match of a chunk may be cut short, and isn't trusted.
        """
        pattern, chunk, overlap = self.pattern, self.chunk, self.overlap

        def cut(batches):
            for b in batches:
                for key, text in zip(b["key"], b["text"], strict=True):
                    for k, s in enumerate(range(0, len(text), chunk)):
                        yield pd.DataFrame({"key": [key], "k": [k], "start": [s], "text": [text[s : s + chunk + overlap]], "more": [s + chunk + overlap < len(text)]})

        def pretokenise(batches):
            match = regex.compile(pattern)
            for b in batches:
                rows = []
                for t, s, more in zip(b["text"], b["start"], b["more"], strict=True):
                    cuts = np.array([m.start() for m in match.finditer(t)] + [len(t)], np.int32)
                    starts = cuts[:-1].astype(np.int64) + s
                    rows.append((cuts, starts[starts <= s + overlap], (starts[:-1] if more else starts)[(starts[:-1] if more else starts) >= s + chunk]))
                yield b[["key", "k", "start", "text"]].assign(cuts=[r[0] for r in rows], head=[r[1] for r in rows], tail=[r[2] for r in rows])

        chunks = texts.select("key", "text").mapInPandas(cut, "key string, k int, start long, text string, more boolean").repartition("key", "k")
        chunks = chunks.mapInPandas(pretokenise, "key string, k int, start long, text string, cuts array<int>, head array<long>, tail array<long>")
        w = Window.partitionBy("key").orderBy("k")
        meet = F.array_min(F.array_intersect("head", F.lag("tail").over(w)))
        chunks = chunks.withColumn("first", F.when(F.col("k") == 0, F.lit(0)).otherwise(meet))
        chunks = chunks.withColumns({"end": F.lead("first").over(w), "whole": (F.col("first").isNotNull())})
        ids = chunks.select("key", "k", "whole", self._encode_cuts(*map(F.col, ("text", "start", "cuts", "first", "end"))).alias("ids"))

        @F.pandas_udf("binary")
        def joined(parts: pd.Series) -> pd.Series:
            return pd.Series([b"".join(p) for p in parts], dtype=object)

        grouped = ids.groupBy("key").agg(F.bool_and("whole").alias("whole"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
        return grouped.where("whole").select("key", joined(F.transform("parts", lambda p: p["ids"])).alias("ids"))

    def encode(self, docs: DataFrame, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
        """`docs` with `ids_col`: the text's token ids as little-endian unsigned 32-bit integers (binary).

        Texts up to one chunk are encoded where they stand. Longer ones, each distinct text once, are cut into
        overlapping chunks that are pre-tokenised in parallel; each chunk hands over to the next at the first
        place in their overlap where both begin a piece, and the pieces between are encoded. Where two chunks
        never meet (one piece longer than the overlap), the text is encoded whole. A null text counts as
        empty: no ids. Rows are independent; repeated rows and extra columns pass through.
        """
        key, held, other = fresh(docs, "bpe_key", "bpe_ids", "bpe_other")
        rest = others(docs, ids_col)
        text = F.coalesce(F.col(text_col), F.lit(""))
        short = docs.where(F.length(text) <= self.chunk).select(*rest, self._encode_whole(text).alias(ids_col))
        long = docs.where(F.length(F.col(text_col)) > self.chunk).withColumn(key, F.sha2(text_col, 256))
        found = self._encode_long(long.groupBy(F.col(key).alias("key")).agg(F.first(text_col).alias("text")))
        long = long.join(found.select(F.col("key").alias(other), F.col("ids").alias(held)), F.col(key) == F.col(other), "left")
        whole = self._encode_whole(F.when(F.col(held).isNull(), F.col(text_col)))
        return short.union(long.select(*rest, F.coalesce(F.col(held), whole).alias(ids_col)))

    def decode(self, ids: Column) -> Column:
        """The bytes that packed ids stand for, concatenated; null stays null, and an unknown id fails."""
        data = self.data

        @F.pandas_udf("binary")
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokens = _Tokens(data.value)
            for packed in _slices(batches):
                yield pd.Series([None if p is None else tokens.decode(p) for p in packed], dtype=object)

        return decode(ids)
