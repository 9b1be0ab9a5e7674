"""Secret scan with a battery of randomness tests, in DataFrame functions only.

Base spans are assignments (``password = ...``), access keys and hex strings, found by pattern.
Beside them every run of ``MIN_LENGTH`` or more key characters (letters, digits, ``+ / _ -``, then
up to two ``=``) is tested, under the smallest alphabet that holds it (``ALPHABETS``):

* chi-squared uniformity over the alphabet. With o(s) places of symbol s the statistic depends on
  the coincidences C = sum o(s) (o(s) - 1) / 2 alone, whose exact mean and variance are known for
  any symbol frequencies; its tails come from the cube-root normal form of a gamma law.
* runs above and below the middle of the alphabet, and the serial correlation of neighbours,
  both two-sided.

Fisher's sum joins the three: a string that is random in its alphabet fails with probability
``ALPHA``. Ordinary writing of that length may pass as well, the shorter the easier. So the same C
is held against the corpus' own symbol frequencies (whole texts, all documents), which gives the
probability that ordinary writing is so even, and Benjamini-Hochberg's step-up keeps the expected
share of ordinary strings among the finds of each alphabet and length class below ``FDR``. A
string counts once there however often it is copied. Strings that pass both are spans of the kind
``random``; they may cover base spans, which they confirm, and never replace them.

Positions are code points, ends exclusive. They are running sums of the lengths of what lies
between matches and of the matches, taken in blocks of ``BLOCK``, so a text of any length with any
number of matches takes about linear time. Null texts are empty. Rows with null or repeated ids
are rows like others. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import keep

# The base kinds, in this order, with their patterns and the least lengths.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]{24,}", 24),
}
MIN_LENGTH = 20
TOKEN = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_LENGTH
ALPHA = 0.001
FDR = 0.01
BLOCK = 512
BINS = 20  # of a probability, to a decade; 300 decades

_D, _L, _U = string.digits, string.ascii_lowercase, string.ascii_uppercase
# smallest first: the first that holds a string is its alphabet
ALPHABETS = [_D, _D + "abcdef", _D + "ABCDEF", _L, _U, _U + "234567", _D + _L, _D + _U, _U + _L, _D + _U + _L,
             _U + _L + _D + "+/", _U + _L + _D + "-_"]
SYMBOLS = _D + _L + _U + "+/-_"


def running_sum(steps: Column) -> Column:
    """Inclusive running sums of a non-empty array, in blocks: linear for any length in use."""
    empty = F.array().cast("array<bigint>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))
    inner = F.transform(blocks, lambda part: F.aggregate(
        part, empty, lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))
    return inner


def _join_blocks(inner: Column) -> Column:
    tops = F.aggregate(inner, F.array(F.lit(0).cast("bigint")),
                       lambda acc, part: F.array_append(acc, F.element_at(acc, -1) + F.element_at(part, -1)))
    return F.flatten(F.zip_with(inner, F.slice(tops, F.lit(1), F.size(inner)), lambda part, base: F.transform(part, lambda x: x + base)))


def located(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Adds ``out``: the matches of ``pattern`` as structs (s, e, m), leftmost and non-overlapping."""
    m, steps, ends = f"{out}_m", f"{out}_steps", f"{out}_ends"
    df = df.withColumn(m, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g).cast("bigint"))
    df = df.withColumn(steps, F.when(F.size(m) > 0, F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), F.col(m), lambda g, x: g + F.char_length(x))))
    df = df.withColumn(ends, F.when(F.size(m) > 0, running_sum(F.col(steps))))
    df = df.withColumn(ends, F.when(F.size(m) > 0, _join_blocks(F.col(ends))))
    spans = F.zip_with(F.col(ends), F.col(m), lambda e, x: F.struct((e - F.char_length(x)).alias("s"), e.alias("e"), x.alias("m")))
    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")
    return df.withColumn(out, F.coalesce(spans, none)).drop(m, steps, ends)


# --- the tests -----------------------------------------------------------------------------------


def upper_normal(z: Column) -> Column:
    """P(N >= z), to 0.3 % of itself: 1 / ((1 - a) z + a sqrt(z z + b)) times the density, z >= 0."""
    x = F.abs(z)
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) / (0.661 * x + 0.339 * F.sqrt(x * x + 5.51))
    return F.when(z < 0, 1 - tail).otherwise(tail)


def coincidences(n: Column, s2, s3) -> tuple[Column, Column]:
    """Mean and variance of C over ``n`` symbols drawn with sum of squares s2 and of cubes s3."""
    pairs = n * (n - 1) / 2
    return pairs * s2, pairs * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * (s3 - s2 * s2)


def gamma_z(c: Column, mean: Column, var: Column) -> Column:
    """The normal score of ``c`` under a gamma law of that mean and variance."""
    a9 = 9 * mean * mean / var
    return (F.cbrt(F.greatest(c, F.lit(0.0)) / mean) - (1 - 1 / a9)) * F.sqrt(a9)


def battery() -> list[Callable[[Column], Column]]:
    """The stages that take structs (s, e, m) to (s, e, m, a, n, c, p): the alphabet's number, the
    length without padding, the coincidences, and Fisher's joint probability of the tests."""
    core = lambda t: F.regexp_replace(t["m"], "=+$", "")

    def alphabet(x: Column) -> Column:
        inside = lambda a: "^[" + a.replace("-", "\\-") + "]+$"
        return F.coalesce(*[F.when(x.rlike(inside(a)), F.lit(i)) for i, a in enumerate(ALPHABETS)])

    def letters(i: Column) -> Column:
        return F.element_at(F.array(*[F.lit(a) for a in ALPHABETS]), i + 1)

    def values(t: Column) -> Column:
        a = letters(t["a"])
        return F.transform(F.split(t["x"], ""), lambda ch: F.call_function("locate", ch, a).cast("double"))

    def coincide(t: Column) -> Column:
        return F.aggregate(F.split(letters(t["a"]), ""), F.lit(0.0), lambda acc, ch: acc + (
            lambda o: o * (o - 1) / 2)((F.char_length(t["x"]) - F.char_length(F.replace(t["x"], ch, F.lit("")))).cast("double")))

    keep_ = lambda t, *names: [t[c].alias(c) for c in ("s", "e", "m", *names)]
    half = lambda t: (t["k"] + 1) / 2

    def runs_p(t: Column) -> Column:
        n, up = t["n"], t["up"]
        twice = 2 * up * (n - up)
        var = twice * (twice - n) / (n * n * (n - 1))
        z = F.abs(t["runs"] - twice / n - 1) / F.sqrt(F.nullif(var, F.lit(0.0)))
        return F.when(var > 0, F.least(2 * upper_normal(z), F.lit(1.0))).otherwise(F.pow(F.lit(2.0), 1 - n))

    def serial_p(t: Column) -> Column:
        n, mean = t["n"], t["sum"] / t["n"]
        den = t["squares"] - n * mean * mean
        num = t["lag"] - mean * (2 * t["sum"] - t["first"] - t["final"]) + (n - 1) * mean * mean
        z = F.abs(num / F.nullif(den, F.lit(0.0)) + 1 / n) * F.sqrt(n)
        return F.when(den > 0, F.least(2 * upper_normal(z), F.lit(1.0))).otherwise(F.pow(F.lit(2.0), 1 - n))

    def uniform_p(t: Column) -> Column:
        mean, var = coincidences(t["n"], 1 / t["k"], 1 / (t["k"] * t["k"]))
        return upper_normal(gamma_z(t["c"] - 0.5, mean, var))

    def fisher(t: Column) -> Column:
        x = -sum((F.log(F.greatest(t[c], F.lit(1e-300))) for c in ("p1", "p2", "p3")), F.lit(0.0))  # half of chi-squared with 6 degrees
        return F.exp(-x) * (1 + x + x * x / 2)

    return [
        lambda t: F.struct(*keep_(t), core(t).alias("x"), alphabet(core(t)).alias("a")),
        lambda t: F.struct(*keep_(t, "x", "a"), F.char_length(t["x"]).cast("double").alias("n"),
                           F.char_length(letters(t["a"])).cast("double").alias("k"), coincide(t).alias("c"), values(t).alias("v")),
        lambda t: F.struct(
            *keep_(t, "a", "n", "k", "c"),
            F.size(F.filter(t["v"], lambda v: v > half(t))).cast("double").alias("up"),
            F.aggregate(F.sequence(F.lit(1), t["n"].cast("int") - 1), F.lit(1.0), lambda acc, i: acc + (
                (F.get(t["v"], i) > half(t)) != (F.get(t["v"], i - 1) > half(t))).cast("double")).alias("runs"),
            F.aggregate(t["v"], F.lit(0.0), lambda acc, v: acc + v).alias("sum"),
            F.aggregate(t["v"], F.lit(0.0), lambda acc, v: acc + v * v).alias("squares"),
            F.aggregate(F.sequence(F.lit(1), t["n"].cast("int") - 1), F.lit(0.0),
                        lambda acc, i: acc + F.get(t["v"], i) * F.get(t["v"], i - 1)).alias("lag"),
            F.get(t["v"], F.lit(0)).alias("first"), F.element_at(t["v"], -1).alias("final")),
        lambda t: F.struct(*keep_(t, "a", "n", "c"), uniform_p(t).alias("p1"), runs_p(t).alias("p2"), serial_p(t).alias("p3")),
        lambda t: F.struct(*keep_(t, "a", "n", "c"), fisher(t).alias("p")),
    ]


def symbol_counts(docs: DataFrame, text_col: str) -> list[int]:
    """How often each of ``SYMBOLS`` occurs in all texts: one row, summed by all tasks."""
    n = F.octet_length(text_col)
    sums = [F.sum(n - F.octet_length(F.replace(text_col, F.lit(s), F.lit("")))).alias(f"s{i}") for i, s in enumerate(SYMBOLS)]
    return [c or 0 for c in docs.agg(*sums).first()]


def backgrounds(counts: list[int]) -> list[tuple[float, float]]:
    """For each alphabet the sums of squares and of cubes of its symbols' shares in the corpus."""
    count = dict(zip(SYMBOLS, counts))
    out = []
    for a in ALPHABETS:
        total = sum(count[s] + 1 for s in a)
        out.append((sum(((count[s] + 1) / total) ** 2 for s in a), sum(((count[s] + 1) / total) ** 3 for s in a)))
    return out


def ordinary_bin(t: Column, background: list[tuple[float, float]]) -> Column:
    """-``BINS`` log10 of the probability that ordinary writing has so few coincidences, as integer."""
    pick = lambda j: F.element_at(F.array(*[F.lit(b[j]) for b in background]), t["a"] + 1)
    mean, var = coincidences(t["n"], pick(0), pick(1))
    p = upper_normal(-gamma_z(t["c"] + 0.5, mean, var))
    return F.floor(-BINS * F.log10(F.greatest(p, F.lit(1e-300)))).cast("int")


def stratum(t: Column) -> Column:
    """Alphabet and length class: four classes to a doubling of the length."""
    return t["a"] * 1000 + F.floor(4 * F.log2(t["n"])).cast("int")


def thresholds(tested: DataFrame, background: list[tuple[float, float]], fdr: float) -> list[tuple[int, int]]:
    """(stratum, least bin of a find) by Benjamini-Hochberg over the distinct strings of a stratum;
    strata without finds are left out. The rows behind it are strata x bins at most."""
    t = tested.select(F.explode("tokens").alias("t"))
    t = t.select(F.xxhash64("t.m").alias("h"), stratum(F.col("t")).alias("st"), ordinary_bin(F.col("t"), background).alias("b")).distinct()
    bins = t.groupBy("st", "b").agg(F.count("*").alias("n"))
    whole = bins.groupBy("st").agg(F.sum("n").alias("m"), F.collect_list(F.struct("b", "n")).alias("bins"))  # 6,000 bins at most
    at_least = F.transform("bins", lambda x: F.struct(x["b"].alias("b"), F.aggregate(
        "bins", F.lit(0).cast("bigint"), lambda acc, y: acc + F.when(y["b"] >= x["b"], y["n"]).otherwise(0)).alias("n")))
    good = F.filter(at_least, lambda x: F.col("m") * F.pow(F.lit(10.0), -x["b"] / BINS) <= fdr * x["n"])
    least = whole.select("st", F.array_min(F.transform(good, lambda x: x["b"])).alias("b")).where("b is not null")
    return [(r.st, r.b) for r in least.collect()]


def _long_enough(kind: str, pattern: str, least: int) -> Callable[[Column], Column]:
    """The match is long enough: of an assignment its value, else the whole."""
    if kind == "assign":
        return lambda t: F.char_length(F.regexp_extract(t["m"], pattern, 2)) >= least
    return lambda t: F.char_length(t["m"]) >= least


def _numbered(kind: int) -> Callable[[Column], Column]:
    return lambda t: F.struct(t["s"].alias("s"), F.lit(kind).alias("k"), t["e"].alias("e"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, fdr: float = FDR) -> DataFrame:
    """Rows (id, base, found): the base spans and all spans, arrays of (s, e, kind) by start, then
    kind, ``random`` last."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = texts
    for kind, (pattern, least) in KINDS.items():
        df = located(df, "text", pattern, kind)
        df = df.withColumn(kind, F.filter(kind, _long_enough(kind, pattern, least)))
    base = F.concat(*[F.transform(kind, _numbered(i)) for i, kind in enumerate(KINDS)])
    df = located(df, "text", TOKEN, "tokens").withColumn("base", F.array_sort(base)).select("id", "base", "tokens")
    for i, stage in enumerate(battery()):
        df = df.withColumn("tokens", F.transform("tokens", stage))
        if i == 0:
            df = df.withColumn("tokens", F.filter("tokens", lambda t: t["a"].isNotNull() & (F.char_length(t["x"]) > 1)))
    tested = keep(df, "secrets")
    background = backgrounds(symbol_counts(texts, "text"))
    least = thresholds(tested, background, fdr)
    limit = F.create_map(*[F.lit(x) for pair in least for x in pair]) if least else F.create_map().cast("map<int,int>")
    random = F.filter("tokens", lambda t: (t["p"] >= alpha) & F.coalesce(
        ordinary_bin(t, background) >= F.try_element_at(limit, stratum(t)), F.lit(False)))
    added = F.transform(random, _numbered(len(KINDS)))
    names = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    name = lambda spans: F.transform(spans, lambda t: F.struct(
        t["s"].alias("s"), t["e"].alias("e"), F.element_at(names, t["k"] + 1).alias("kind")))
    return tested.select("id", name(F.col("base")).alias("base"), name(F.array_sort(F.concat("base", added))).alias("found"))
