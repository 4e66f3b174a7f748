"""Secret scans with DataFrame functions only.

Three fixed patterns give the base spans. Beside them, runs of 20 or more characters that an encoding uses are put to a battery
of tests: the chi-squared statistic against an even use of the inferred alphabet, the number of runs above and below the
alphabet's middle, and the correlation of neighbouring symbols. Each tests the hypothesis that the string departs from
randomness as ordinary writing does, so that a small chance speaks for a random string; the largest of the three counts. The
Benjamini-Hochberg rule then holds the share of false discoveries among all strings of the table, each chance being divided by a
weight that grows with the string's length and has mean one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import cut, hidden

# The kinds in order, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Least length of a string that is tested, and the share of false discoveries that is allowed.
LEAST = 20
FALSE_SHARE = 0.05
CANDIDATE = r"[A-Za-z0-9+/_=-]"
#: The chance that two letters of ordinary writing are equal, the least unevenness that counts as a departure, and the
#: departures of runs (as a share of the expected number) and of serial correlation.
COINCIDENCE, LEAST_UNEVEN, RUNS_MARGIN, SERIAL_MARGIN = 0.065, 0.6, 0.5, 0.6
#: Chances are counted in thousandths of their decimal logarithm, rounded towards 1, up to this many.
BINS = 30_000

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings by alphabet, the first that fits is inferred; padding is cut off and the URL form of base64 is mapped to the other before.
ENCODINGS = (
    ("decimal", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("lower", _LOWER),
    ("upper", _UPPER),
    ("base32", _UPPER + "234567"),
    ("lower36", _DIGITS + _LOWER),
    ("upper36", _DIGITS + _UPPER),
    ("letters", _UPPER + _LOWER),
    ("base62", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
)
BLOCK = 64


def add_found(df: DataFrame, text: str, pattern: str, keep, out: str, group: int = 0) -> DataFrame:
    """``df`` with the column ``out``: structs of start, end and value of the pattern's leftmost, non-overlapping matches that ``keep`` accepts.

    ``keep`` gets the value of ``group``. Positions count code points: what lies between matches comes from splitting by the same pattern,
    and running sums of lengths are taken in blocks, so that many matches stay cheap. What a lambda refers to is a column, named
    twice at least, for otherwise it would be computed anew for each match.
    """
    whole, parts, gaps, lengths, blocks, starts = (F.col(f"{out}_{k}") for k in ("whole", "parts", "gaps", "lengths", "blocks", "starts"))
    none = F.array().cast("array<string>")
    zero, add = F.lit(0), lambda a, b: a + b
    every = F.sequence(zero, F.size(whole) - 1)

    def before(i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        return F.aggregate(F.slice(blocks, F.lit(1), block), zero, add) + F.aggregate(F.slice(lengths, block * BLOCK + 1, i - block * BLOCK), zero, add)

    kept = df.columns
    df = df.withColumn(f"{out}_whole", F.when(F.col(text).rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size(whole) > 0
    df = df.withColumn(f"{out}_parts", F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole).otherwise(none))
    df = df.withColumn(f"{out}_gaps", F.when(some, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn(f"{out}_lengths", F.flatten(F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, m: F.array(F.char_length(g), F.char_length(m)))))
    df = df.withColumn(f"{out}_blocks", F.when(some, F.transform(F.sequence(zero, F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, BLOCK), zero, add))))
    df = df.withColumn(f"{out}_starts", F.when(some & (F.size(blocks) > 0), F.transform(every, lambda i: before(2 * i + 1))))
    span = lambda m, i: F.struct(F.get(starts, i).cast("int").alias("start"), (F.get(starts, i) + F.char_length(m)).cast("int").alias("end"), F.get(parts, i).alias("value"))
    spans = F.when((F.size(starts) > 0) & (F.size(parts) > 0), F.filter(F.transform(whole, span), lambda s: keep(s["value"])))
    return df.select(*kept, F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,value:string>>")).alias(out))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normal_cdf(z: Column) -> Column:
    """The normal distribution function, to 8e-8 absolutely and within a few per cent far below 0."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    # The coefficients of the usual rational approximation.
    terms = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * reduce(lambda a, c: (a + c) * t, reversed(terms), F.lit(0.0))
    return F.when(z < 0, tail).otherwise(1 - tail)


def battery(tokens: Column) -> Column:
    """For each struct (start, end, value) also encoding, n, chi2, runs, serial, and ``chance`` as the module says."""
    trim = lambda v: F.translate(F.regexp_replace(v, "=+$", ""), "-_", "+/")
    index = lambda v: reduce(lambda other, i: F.when(v.rlike(f"^[{ENCODINGS[i][1]}]*$"), F.lit(i)).otherwise(other), reversed(range(len(ENCODINGS))), F.lit(len(ENCODINGS) - 1))
    pick = lambda i, values: F.get(F.array(*map(F.lit, values)), i)
    alphabets = [a for _, a in ENCODINGS]
    halves = ["0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2) for a in alphabets]
    with_code = F.transform(tokens, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), trim(c["value"]).alias("v"), index(trim(c["value"])).alias("code")))
    with_signs = F.transform(with_code, lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["v"].alias("v"), c["code"].alias("code"), F.greatest(F.char_length(c["v"]), F.lit(1)).cast("double").alias("n"),
        pick(c["code"], [float(len(a)) for a in alphabets]).alias("k"),
        reduce(lambda other, i: F.when(c["code"] == i, F.translate(c["v"], alphabets[i], halves[i])).otherwise(other), range(len(alphabets)), F.lit("")).alias("bits"),
        F.transform(F.split(c["v"], ""), lambda s: F.instr(pick(c["code"], alphabets), s).cast("double")).alias("values"),
    ))

    def statistics(c: Column) -> Column:
        n, k, values = c["n"], c["k"], c["values"]
        count = lambda s: n - F.char_length(F.replace(c["v"], s, F.lit("")))
        squares = _sum(F.transform(F.array_distinct(F.split(c["v"], "")), lambda s: F.pow(count(s), F.lit(2.0))))
        ones = F.char_length(F.regexp_replace(c["bits"], "0", "")).cast("double")
        runs = F.size(F.regexp_extract_all(c["bits"], F.lit("0+|1+"), F.lit(0))).cast("double")
        mean = _sum(values) / n
        spread = _sum(F.transform(values, lambda x: x * x)) - n * mean * mean
        less = F.greatest(F.size(values) - 1, F.lit(0))
        ends = F.coalesce(F.get(values, F.lit(0)) + F.get(values, less), F.lit(0.0))
        cross = _sum(F.zip_with(F.slice(values, F.lit(1), less), F.slice(values, F.lit(2), less), lambda a, b: a * b)) - mean * (2 * n * mean - ends) + (n - 1) * mean * mean
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), pick(c["code"], [e for e, _ in ENCODINGS]).alias("encoding"), n.alias("n"), k.alias("k"), (squares * k / n - n).alias("chi2"),
            runs.alias("runs"), ones.alias("ones"), F.when(spread > 0, cross / spread).otherwise(1.0).alias("serial"),
        )

    def judged(c: Column) -> Column:
        n, k = c["n"], c["k"]
        uneven = n * F.greatest(k * COINCIDENCE - 1, F.lit(LEAST_UNEVEN))
        of_chi = normal_cdf((c["chi2"] - (k - 1 + uneven)) / F.sqrt(2 * (k - 1 + 2 * uneven)))
        both = 2 * c["ones"] * (n - c["ones"])
        expected, variance = both / n + 1, both * (both - n) / (n * n * F.greatest(n - 1, F.lit(1.0)))
        of_runs = F.when(variance > 0, normal_cdf((F.abs(c["runs"] - expected) - RUNS_MARGIN * expected) / F.sqrt(variance))).otherwise(1.0)
        of_serial = normal_cdf((F.abs(c["serial"]) - SERIAL_MARGIN) * F.sqrt(n))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"), n.alias("n"), c["chi2"].alias("chi2"), c["runs"].alias("runs"), c["serial"].alias("serial"), F.greatest(of_chi, of_runs, of_serial).alias("chance"))

    return F.transform(F.transform(with_signs, statistics), judged)


def discoveries(rows: DataFrame, share: float = FALSE_SHARE):
    """A column function of (chance, n): whether the string is a discovery among all strings in ``rows.tests``.

    The strings' chances, which are few, go to the shared folder. The driver gets one row with the sum of weights, then a row for
    each bin of chances, ``BINS`` at most.
    """
    # Not explode() or a filter on the arrays: the optimizer would copy their whole expressions below, lambdas within lambdas.
    tests = rows.select(F.explode_outer("tests").alias("t")).filter(F.col("t").isNotNull())
    tests = cut(tests.select("t.chance", F.sqrt("t.n").alias("weight")))
    total = tests.agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).first()
    if not total.n:
        return lambda chance, n: F.lit(False)
    mean = total.weight / total.n
    bin_of = lambda chance, weight: F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(-1000 * F.log10(F.greatest(chance / (weight / mean), F.lit(1e-35))))))
    counted = tests.groupBy(bin_of(F.col("chance"), F.col("weight")).alias("bin")).count().collect()
    so_far, least = 0, BINS + 1
    for b, c in sorted(((r.bin, r["count"]) for r in counted), reverse=True):
        so_far += c
        if 10 ** (-b / 1000) * total.n <= share * so_far:
            least = b
    return lambda chance, n: bin_of(chance, F.sqrt(n)) >= least


def _long(least: int):
    return lambda value: F.char_length(value) >= least


def _runs(pattern: str, least: int) -> str:
    """The pattern of maximal runs, with its least length put into the quantifier: the matches are those that a later filter would leave."""
    return f"{pattern.removesuffix('+')}{{{least},}}"


def _with_tests(df: DataFrame) -> DataFrame:
    df = add_found(df, "scanned", _runs(f"{CANDIDATE}+", LEAST), _long(LEAST), "found_random")
    return df.withColumn("tests", battery(F.col("found_random")))


def scan(df: DataFrame, *, text_col: str = "text", share: float = FALSE_SHARE) -> DataFrame:
    """All columns of ``df`` and ``secret_spans``, structs of (start, kind_order, end, kind) in order: base spans, and discoveries that meet none of them.

    The table is read twice, first for the chances of all strings. A null text counts
    as empty and has no spans. Repeated rows have equal spans; an empty table gives no rows. A column that is called
    ``secret_spans`` already is replaced; other names can't clash.
    """
    df = df.drop("secret_spans")
    text = F.coalesce(F.col(text_col), F.lit("")).alias("scanned")
    held = discoveries(_with_tests(df.select(text)), share)
    kept = hidden(df)
    scanned = F.coalesce(F.col(f"kept_{df.columns.index(text_col)}"), F.lit("")).alias("scanned")
    marked = _with_tests(kept.select(*kept.columns, scanned))
    marked = add_found(marked, "scanned", ASSIGN, _long(ASSIGN_LEAST), "found_assign", 2)
    marked = add_found(marked, "scanned", _runs(ACCESS, ACCESS_LEAST - 4), _long(ACCESS_LEAST), "found_access")
    marked = add_found(marked, "scanned", _runs(HEX, HEX_LEAST), _long(HEX_LEAST), "found_hex")
    kind = lambda name: lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(name)).alias("kind_order"), s["end"].alias("end"), F.lit(name).alias("kind"))
    marked = marked.withColumn("base", F.concat(*(F.transform(f"found_{name}", kind(name)) for name in KINDS[:3])))
    fresh = F.filter("tests", lambda t: held(t["chance"], t["n"]) & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    spans = F.sort_array(F.concat("base", F.transform(fresh, kind("random"))))
    return marked.select(*kept.columns, spans.alias("secret_spans")).toDF(*df.columns, "secret_spans")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or group of overlapping spans, replaced by ``mark``; a text without spans, or null, stays as it is."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    rest = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(text.isNotNull() & (F.size(spans) > 0), rest).otherwise(text)
