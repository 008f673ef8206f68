"""Secret scans: pattern kinds, and a battery of randomness tests for everything else.

The pattern kinds (assign, access, hex) give the base spans. Other runs of 20 token
characters or more are candidates for the kind `random`. For each, an encoding is inferred from
its characters, which gives an alphabet and every character's place in it. Three tests ask
whether the places look drawn at random from that alphabet: chi-squared uniformity, runs
above and below the middle, and serial correlation at lag one; a candidate that any of them
rejects at ALPHA / 3 goes. The other direction, whether ordinary text could look so, is a
test of its index of coincidence against ordinary concentration, whose power grows with
length: short tokens can't pass it by luck. Over these p-values the false discovery rate is
held at RATE by the Benjamini-Hochberg rule, for each class of lengths by itself.

Scale: DataFrame functions only, no shuffle of texts or candidates. p-values are counted in
bins of a tenth of a decade, upper edges standing for the bin, so the rule needs a table of
at most LENGTHS times BINS rows, and its result is one threshold per class of lengths.

Defined cases: null texts are empty and have no spans; padding with no more than one character before it is no candidate; spans count code points; kinds may
overlap each other, `random` spans never overlap base spans; repeated rows give equal
rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}+"  # [0-9a-f]+ of 24 or more: runs are maximal either way
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHA, RATE = 0.003, 0.01
#: Classes of lengths begin here.
LENGTHS = (20, 28, 40, 64)
BINS = 400

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings in the order in which they are tried: pattern, alphabet.
ENCODINGS = (
    (r"^[0-9]+$", _DIGITS),
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[a-z]+$", _LOWER),
    (r"^[A-Z]+$", _UPPER),
    (r"^[A-Z2-7]+$", _UPPER + "234567"),
    (r"^[a-z0-9]+$", _LOWER + _DIGITS),
    (r"^[A-Z0-9]+$", _UPPER + _DIGITS),
    (r"^[A-Za-z]+$", _UPPER + _LOWER),
    (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    (r"^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    (r"", _UPPER + _LOWER + _DIGITS + "+/-_="),
)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches, not overlapping: array of (start, end, found), in code points, end exclusive.

    What stands between matches comes from split, the matches from regexp_extract_all;
    running lengths of both give places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    shown = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, found: STRING>>)").alias("out"))

    def step(a, x):
        begin = a["at"] + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["shown"].alias("found")))).alias("out"))

    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("whole"), shown.alias("shown"))
    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step, lambda a: a["out"])).otherwise(start["out"])


def _above(z: Column) -> Column:
    """Upper tail of the normal distribution, by a rational approximation good to 1e-7 in the middle and in ratio far out."""
    t = F.lit(1.0) / (1 + 0.2316419 * F.abs(z))
    density = 0.3989422804014327 * F.exp(-z * z / 2)
    tail = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _with(items: Column, **made) -> Column:
    """Items with fields added, each computed once from the fields before."""

    def adding(name, f):
        return lambda c: c.withField(name, f(c))

    for name, f in made.items():
        items = F.transform(items, adding(name, f))
    return items


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))


def tested(candidates: Column) -> Column:
    """Candidates with p-values: `random` (the least of three, times three) and `plain` (ordinary text)."""

    def alphabet(c):
        bare = c["bare"]
        out = F.lit(ENCODINGS[-1][1])
        for pattern, letters in reversed(ENCODINGS[:-1]):
            out = F.when(bare.rlike(pattern), F.lit(letters)).otherwise(out)
        return out

    def uniform(c):
        """Chi-squared, as a normal value by the cube-root transform."""
        free = c["k"] - 1
        chi = c["k"] / c["n"] * c["squares"] - c["n"]
        return _above((F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))

    def runs(c):
        high = _sum(c["places"], lambda x: F.when(2 * x >= c["k"], 1.0).otherwise(0.0))
        low = c["n"] - high
        mean = 2 * high * low / c["n"] + 1
        spread = F.sqrt((mean - 1) * (mean - 2) / (c["n"] - 1))
        return F.when((high > 1) & (low > 1), 2 * _above(F.abs((c["runs"] - mean) / spread))).otherwise(0.0)

    def serial(c):
        products = F.zip_with(F.slice(c["places"], F.lit(1), c["n"].cast("int") - 1), F.slice(c["places"], F.lit(2), c["n"].cast("int") - 1), lambda x, y: (x - c["mean"]) * (y - c["mean"]))
        return F.when(c["spread"] > 0, 2 * _above(F.abs(_sum(products, lambda x: x) / c["spread"] * F.sqrt(c["n"])))).otherwise(0.0)

    def plain(c):
        """Pairs of equal characters against what ordinary text of that alphabet would have."""
        pairs = c["n"] * (c["n"] - 1)
        ordinary = F.greatest(2 / c["k"], F.lit(0.065))
        return _above((ordinary - (c["squares"] - c["n"]) / pairs) / F.sqrt(2 * ordinary * (1 - ordinary) / pairs))

    return _with(
        candidates,
        bare=lambda c: F.regexp_replace(c["found"], "=+$", ""),
        letters=alphabet,
        k=lambda c: F.length(c["letters"]).cast("double"),
        places=lambda c: F.transform(F.filter(F.split(c["bare"], ""), lambda x: x != ""), lambda x: (F.instr(c["letters"], x) - 1).cast("double")),
        n=lambda c: F.size(c["places"]).cast("double"),
        squares=lambda c: _sum(F.array_distinct(c["places"]), lambda x: F.pow(F.size(F.filter(c["places"], lambda y: y == x)).cast("double"), F.lit(2.0))),
        mean=lambda c: _sum(c["places"], lambda x: x) / c["n"],
        spread=lambda c: _sum(c["places"], lambda x: F.pow(x - c["mean"], F.lit(2.0))),
        runs=lambda c: 1 + _sum(F.zip_with(F.slice(c["places"], F.lit(1), c["n"].cast("int") - 1), F.slice(c["places"], F.lit(2), c["n"].cast("int") - 1), lambda x, y: F.when((2 * x >= c["k"]) != (2 * y >= c["k"]), 1.0).otherwise(0.0)), lambda x: x),
        random=lambda c: F.least(F.lit(1.0), 3 * F.least(uniform(c), runs(c), serial(c))),
        plain=plain,
    )


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(LENGTHS[1:], 1):
        out = F.when(n >= least, k).otherwise(out)
    return out


def thresholds(candidates: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each class of lengths, the least bin of -10 * log10(p) that is a discovery; from (length, bin) rows."""
    counts = candidates.groupBy("length", "bin").agg(F.count(F.lit(1)).alias("n"))
    # at most LENGTHS times BINS rows from here on
    down = Window.partitionBy("length").orderBy(F.desc("bin"))
    steps = counts.select("length", "bin", F.sum("n").over(down).alias("k"), F.sum("n").over(Window.partitionBy("length")).alias("m"))
    passed = steps.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= rate * F.col("k") / F.col("m"))
    return {r[0]: r[1] for r in passed.groupBy("length").agg(F.min("bin")).collect()}


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """docs' doc_id with arrays of (start, end) for assign, access, hex and random."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = docs.select(
        "doc_id",
        bare(F.filter(spans(text, ASSIGN, 2), lambda s: F.length(s["found"]) >= LEAST_ASSIGNED)).alias("assign"),
        bare(F.filter(spans(text, ACCESS), lambda s: F.length(s["found"]) >= LEAST_ACCESS)).alias("access"),
        bare(spans(text, HEX)).alias("hex"),
        spans(text, CANDIDATE).alias("candidates"),
    )
    found = stash(found, "secret-spans")
    base = F.concat("assign", "access", "hex")
    free = F.filter("candidates", lambda c: (F.length(F.regexp_replace(c["found"], "=+$", "")) > 1) & ~F.exists(base, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    scored = F.transform(tested(free), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["random"].alias("random"), _length_class(c["n"]).alias("length"), F.least(F.lit(BINS - 1), F.floor(-10 * F.log10(F.greatest(c["plain"], F.lit(1e-300))))).cast("int").alias("bin")))
    found = stash(found.select("doc_id", "assign", "access", "hex", F.when(F.size("candidates") > 0, scored).otherwise(F.slice(scored, F.lit(1), F.lit(0))).alias("scored")), "secret-tests")
    left = F.filter("scored", lambda c: c["random"] >= ALPHA)
    least = thresholds(found.select(F.explode(left).alias("c")).select("c.length", "c.bin"), rate)
    limit = lambda c: F.coalesce(*(F.when(c["length"] == k, b) for k, b in least.items()), F.lit(BINS))
    passed = F.filter("scored", lambda c: (c["random"] >= ALPHA) & (c["bin"] >= limit(c)))
    return found.select("doc_id", "assign", "access", "hex", bare(passed).alias("random"))


def listed(*kinds: str) -> Column:
    """kind:start:end of the spans by start, then kind as listed, comma-joined."""

    def named(kind):
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    parts = [named(k) for k in kinds]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, their checksum, and all spans."""
    found = scan(docs.select("doc_id", "text"))
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found.select("doc_id", size("assign"), size("access"), size("hex"), F.sha2(listed(*KINDS[:3]), 256).alias("base_sha256"), listed(*KINDS).alias("spans"))
