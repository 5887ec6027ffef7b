"""Secret scans (operator 2): patterns, and windows of high entropy. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, others

#: Kinds in their listed order; the last two are the entropy method's.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 20 or more that begins with AKIA is the same span as AKIA[A-Z0-9]+ with the short ones dropped; likewise hex.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Candidate strings of the entropy method; a window's length, and the bits a character that each class must reach.
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
HEX_CLASS = "^[0-9a-fA-F]+$"
WINDOW = 20
BITS = {"entropy_hex": 3.0, "entropy_base64": 3.9}
#: Allow-list: candidates that match are never flagged by entropy (UUIDs; words and paths without digits; plain numbers and rules).
ALLOW = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[A-Za-z/_=+-]+$",
    "^[0-9/_=+-]+$",
)
#: Values folded at a time; windows of a candidate that are counted in one piece; the characters of candidates, as codes.
BLOCK, PIECE = 64, 2048
CODES, PACKED = (ord("+"), ord("z")), 12
#: n log2 n of a count.
TERMS = [n * math.log2(n) if n else 0.0 for n in range(WINDOW + 2)]
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _span(start: Column, kind: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), kind.alias("kind"), end.alias("end"))


def _before(values: Column, step, start: int) -> Column:
    """For each of an array of integers, what `step` makes of `start` and all values before it (a running sum or maximum).

    Arrays grow by copying, so the fold runs within blocks of BLOCK values, and over the blocks: the work grows about
    with the number of values.
    """

    def fold(array: Column) -> Column:
        begin = F.struct(F.lit(start).alias("now"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(array, begin, lambda s, x: F.struct(step(s["now"], x).alias("now"), F.concat(s["out"], F.array(s["now"])).alias("out")))

    def placed(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: fold(F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))
        return F.flatten(_zipped(blocks, lambda folded: fold(F.transform(folded, lambda x: x["now"]))["out"], lambda x, base: F.transform(x["out"], lambda v: step(base, v))))

    return _bound(values, placed)


def _bound(value: Column, use) -> Column:
    """use(value), with `value` evaluated once however often it is read: a lambda's body is evaluated anew at every use."""
    return F.transform(F.array(value), use)[0]


def _zipped(array: Column, other, join) -> Column:
    """zip_with(a, other(a), join) for a = `array`, which is evaluated once."""
    return _bound(array, lambda a: F.zip_with(a, other(a), join))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, hit, part>> of a pattern's leftmost matches; part: the match's `group`.

    Between the matches lie the pieces of a split, so running sums of their lengths (in code points) give the places.
    """
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    hits = F.zip_with(F.split(text, pattern, -1), found(0), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    hits = F.zip_with(hits, found(group), lambda x, part: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), part.alias("part")))
    hits = F.filter(hits, lambda x: x["hit"].isNotNull())
    ends = lambda a: _before(F.transform(a, lambda x: x["gap"] + F.length(x["hit"])), lambda s, n: s + n, 0)
    placed = _zipped(hits, ends, lambda x, at: F.struct((at + x["gap"]).alias("start"), x["hit"].alias("hit"), x["part"].alias("part")))
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast("array<struct<start:int,hit:string,part:string>>"))


def _base(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    hits = F.filter(_matches(text, pattern, group), lambda x: F.length(x["part"]) >= least)
    return F.transform(hits, lambda x: _span(x["start"], F.lit(kind), x["start"] + F.length(x["hit"])))


def _place(code: Column, name: str) -> list[Column]:
    """Where a character's count lies in the packed counts: the integer, the shift, and one at that place; null for none."""
    shift = (code % PACKED * 5).cast("int")
    return [F.floor(code / PACKED).cast("int").alias(f"{name}_at"), shift.alias(f"{name}_shift"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias(f"{name}_one")]


def _hot_in(word: Column, first: Column, n: Column, most: Column) -> Column:
    """array<struct<a, b>>: runs of hot windows among the `n` characters from `first` (0-based) of a candidate.

    The state holds the window's count of each character (five bits each, PACKED to an integer), and the sum of
    n log2 n over the counts. When the window moves by one, the entering character's count goes up, the leaving one's
    down, and the sum takes their terms' changes.
    """
    code = lambda i: F.ascii(F.substring(word, first + i, F.lit(1)).cast("string")) - CODES[0]
    runs, terms = "array<struct<a:int,b:int>>", F.array(*map(F.lit, TERMS))
    moves = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), code(i).alias("into"), F.when(i > WINDOW, code(i - WINDOW)).alias("out")))
    moves = F.transform(moves, lambda m: F.struct(m["i"].alias("i"), *_place(m["into"], "into"), *_place(m["out"], "out")))
    count = lambda s, m, k: F.call_function("shiftright", F.get(s["counts"], m[f"{k}_at"]), m[f"{k}_shift"]).bitwiseAND(F.lit(31)).cast("int")

    def counted(s: Column, m: Column) -> Column:
        """The state with the leaving character taken out and the entering one put in, each with its terms' change."""
        less, more = count(s, m, "out"), count(s, m, "into")
        gone = (m["out_at"] == m["into_at"]) & (m["out_shift"] == m["into_shift"])
        change = F.when(F.coalesce(gone, F.lit(False)), F.lit(0.0)).otherwise(
            F.get(terms, more + 1) - F.get(terms, more) + F.coalesce(F.get(terms, less - 1) - F.get(terms, less), F.lit(0.0))
        )
        counts = F.transform(s["counts"], lambda c, k: c + F.when(k == m["into_at"], m["into_one"]).otherwise(F.lit(0).cast("long")) - F.when(k == m["out_at"], m["out_one"]).otherwise(F.lit(0).cast("long")))
        return F.struct(m["i"].alias("i"), counts.alias("counts"), (s["sum"] + change).alias("sum"))

    def step(s: Column, m: Column) -> Column:
        new = counted(s, m)
        b = first + m["i"]
        return F.struct(new["counts"].alias("counts"), new["sum"].alias("sum"), F.when((m["i"] >= WINDOW) & (new["sum"] <= most), _added(s["out"], b)).otherwise(s["out"]).alias("out"))

    zeros = F.array(*[F.lit(0).cast("long")] * ((CODES[1] - CODES[0]) // PACKED + 1))
    begin = F.struct(zeros.alias("counts"), F.lit(0.0).alias("sum"), F.array().cast(runs).alias("out"))
    return F.aggregate(moves, begin, step, lambda s: s["out"])


def _added(runs: Column, b: Column) -> Column:
    """Runs with the window that ends at `b`: the last run grown, or one more."""
    a, last = b - WINDOW, F.element_at(runs, -1)
    grown = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["a"].alias("a"), b.alias("b"))))
    new = F.array(F.struct(a.alias("a"), b.alias("b")))
    return F.when(F.size(runs) == 0, new).when(last["b"] >= a, grown).otherwise(F.concat(runs, new))


def hot_windows(word: Column, most: Column) -> Column:
    """array<struct<a, b>>: the runs, in a candidate (ASCII, as binary), of windows whose counts' n log2 n sum up to `most` or less.

    Entropy is log2(WINDOW) - sum(n log2 n) / WINDOW over the counts n of a window's characters, which `_hot_in` carries
    along. Long candidates go in pieces of PIECE windows, each with the characters its windows need; runs that touch
    where pieces meet are joined.
    """
    windows = F.octet_length(word) - WINDOW + 1
    pieces = F.transform(F.sequence(F.lit(0), F.floor((windows - 1) / PIECE).cast("int")), lambda k: _hot_in(word, k * PIECE, F.least(windows - k * PIECE, F.lit(PIECE)) + WINDOW - 1, most))
    # neither the start nor the end of a run that goes on counts; ends stand where starts do
    first = lambda a: F.filter(a, lambda x, i: F.coalesce(F.get(a, i - 1)["b"] < x["a"], F.lit(True)))
    last = lambda a: F.filter(a, lambda x, i: F.coalesce(F.get(a, i + 1)["a"] > x["b"], F.lit(True)))
    return _bound(F.flatten(pieces), lambda a: F.zip_with(first(a), last(a), lambda x, y: F.struct(x["a"].alias("a"), y["b"].alias("b"))))


def _entropy(text: Column) -> Column:
    """Spans of the entropy method. Each step binds what the next reads more than once (lambdas are evaluated anew at every use)."""
    allowed = lambda c: F.lit(False) if not ALLOW else c.rlike("|".join(ALLOW))
    most = {k: WINDOW * (math.log2(WINDOW) - BITS[KINDS[k]]) + 1e-9 for k in (3, 4)}
    hits = F.filter(_matches(text, CANDIDATE), lambda x: ~allowed(x["hit"]))
    hits = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.when(x["hit"].rlike(HEX_CLASS), F.lit(3)).otherwise(F.lit(4)).alias("kind"), x["hit"].cast("binary").alias("word")))
    hits = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), hot_windows(x["word"], F.when(x["kind"] == 3, most[3]).otherwise(most[4])).alias("hot")))
    return F.flatten(F.transform(hits, lambda x: F.transform(x["hot"], lambda r: _span(x["start"] + r["a"], x["kind"], x["start"] + r["b"]))))


def _clear(spans: Column) -> Column:
    """Of sorted spans, the base ones and those that no base one overlaps.

    A base span before one overlaps it if it ends beyond its start: a running maximum tells. Of those behind it, the
    nearest base span starts first: a running minimum from the end tells.
    """
    base = lambda x, value, other: F.when(x["kind"] < 3, value).otherwise(F.lit(other))
    reach = lambda a: _before(F.transform(a, lambda x: base(x, x["end"], 0)), lambda s, v: F.greatest(s, v), 0)
    most = (1 << 31) - 1
    ahead = lambda a: F.reverse(_before(F.transform(F.reverse(a), lambda x: base(x, x["start"], most)), lambda s, v: F.least(s, v), most))
    marked = _zipped(spans, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r")))
    marked = _zipped(marked, lambda a: ahead(F.transform(a, lambda m: m["x"])), lambda m, n: F.struct(m["x"].alias("x"), (m["r"] <= m["x"]["start"]).alias("left"), (n >= m["x"]["end"]).alias("right")))
    return F.transform(F.filter(marked, lambda m: (m["x"]["kind"] < 3) | (m["left"] & m["right"])), lambda m: m["x"])


def scan_secrets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """`docs` with `secrets`: array<struct<start, kind, end>>, sorted; kind indexes KINDS, places are code points, end exclusive.

    Kinds 0 to 2 are the base patterns' leftmost non-overlapping matches (assignments only with six
    characters or more of value). Kinds 3 and 4 are the entropy method's: stretches of a candidate string
    whose windows reach its class's bits, unless the allow-list has the candidate or a base span overlaps.
    A null or empty text has no secrets. Rows are independent: repeated rows, ids and extra columns pass through
    (one named secrets, in any case, is replaced).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(_base(text, ASSIGN, 0, 2, 6), _base(text, ACCESS, 1), _base(text, HEX, 2))
    rest = others(docs, "secrets")
    first, second = fresh(docs, "secrets_base", "secrets_more")
    out = docs.select(*rest, base.cast(SPANS).alias(first), _entropy(text).cast(SPANS).alias(second))
    own = named(*(c for c in docs.columns if c.lower() != "secrets"))
    every = F.array_sort(F.concat(first, second))
    return out.select(*own, F.when((F.size(first) == 0) | (F.size(second) == 0), every).otherwise(_clear(every)).alias("secrets"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
