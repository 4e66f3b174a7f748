import random
import re

import pytest
from pyspark.sql import functions as F

from vertexloom.llm import secrets

from .conftest import prose

# The contract's patterns, written for Python.
PATTERNS = [
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[g]) >= least]
    return [(a, name, b) for a, _, b, name in sorted(found)]


def spans(df):
    return {r.doc_id: [(s.start, s.kind, s.end) for s in r.secret_spans] for r in secrets.scan(df).collect()}


def test_base_spans_of_odd_texts(odd, none):
    got = spans(odd)
    for r in odd.collect():
        assert [s for s in got[r.doc_id] if s[1] != "random"] == base(r.text), r.doc_id
    assert got[0] == [] and secrets.scan(none).count() == 0
    assert secrets.scan(odd).columns == [*odd.columns, "secret_spans"]


def test_patterns_on_hard_strings(spark):
    hard = [
        "token=token = abcdefgh", "token=pass password=xxxxxx", "TOKEN: 'a.b-c_d'", "api_key=short apikey = longenough=", "secret\"  :  \"abcdef", "éé😀 token=abcdef😀AKIA" + "Z" * 16,
        "AKIAAKIA" + "Q" * 12 + " AKIA" + "Q" * 15, "0" * 24 + "g" + "a" * 23 + "x" + "f" * 60, "passwd=" + "=" * 6, "tokentokentoken===abcdef", "secret = password = abcdefg", "0123456789abcdef01234567apikey=abcdef",
    ]
    r = random.Random(4)
    hard += ["".join(r.choice(["token", "=", " ", "abc", "AKIA", "Z9Z9Z9Z9", "0a" * 6, "é", "'", "secret", ":"]) for _ in range(40)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    got = spans(df)
    for i, t in enumerate(hard):
        assert [s for s in got[i] if s[1] != "random"] == base(t), t


def test_random_strings_are_found_and_words_are_not(spark):
    r = random.Random(7)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(r.choice(chars) for _ in range(n)) for n in (40, 48, 64, 88, 120) * 8]
    words = ["internationalisierungsmassnahmen" + w for w in ("verwaltung", "ordnung", "plan")] + ["a" * 50, "ab" * 30, "0" * 40 + "z", "this-is-a-rather-long-identifier-name", "path/to/some/ordinary/folder/of/files"]
    rows = [(i, f"{prose(i, 20)} {k} {prose(i + 1, 20)}") for i, k in enumerate(keys)] + [(100 + i, f"{prose(i, 9)} {w} x") for i, w in enumerate(words)]
    got = spans(spark.createDataFrame(rows, "doc_id long, text string"))
    hit = sum(any(k == "random" and rows[i][1][a:b] == key for a, k, b in got[i]) for i, key in enumerate(keys))
    assert hit >= 0.9 * len(keys)
    assert not any(k == "random" for i in range(len(words)) for _, k, _ in got[100 + i])


def test_statistics_against_plain_formulas(spark):
    import math

    token = "0123456789abcdef" * 2 + "0f0f"
    df = spark.createDataFrame([(0, token)], "start int, value string").select(F.array(F.struct("start", F.lit(36).alias("end"), "value")).alias("t"))
    got = df.select(F.explode(secrets.battery(F.col("t"))).alias("b")).first().b
    n, k = len(token), 16
    want = sum(token.count(c) ** 2 for c in set(token)) * k / n - n
    bits = [int(c, 16) >= 8 for c in token]
    v = [int(c, 16) + 1 for c in token]
    m = sum(v) / n
    serial = sum((a - m) * (b - m) for a, b in zip(v, v[1:])) / sum((a - m) ** 2 for a in v)
    assert got.encoding == "hex" and got.chi2 == pytest.approx(want) and got.runs == 1 + sum(a != b for a, b in zip(bits, bits[1:])) and got.serial == pytest.approx(serial)
    for z in (-6.0, -2.0, -0.3, 0.0, 1.5):
        assert spark.range(1).select(secrets.normal_cdf(F.lit(z)).alias("p")).first().p == pytest.approx(0.5 * math.erfc(-z / 2**0.5), rel=0.05, abs=1e-7)


def test_many_matches_in_one_text(spark):
    text = " ".join("0123456789abcdef01234567" for _ in range(3000))
    got = spans(spark.createDataFrame([(0, text)], "doc_id long, text string"))[0]
    assert [s for s in got if s[1] == "hex"] == base(text)


def test_redaction(spark):
    df = spark.createDataFrame([(0, "é token=abcdef, x"), (1, None), (2, "plain"), (3, "AKIA" + "Q" * 16), (4, "0123456789abcdef01234567apikey=abcdef end")], "doc_id long, text string")
    made = secrets.scan(df).select("doc_id", secrets.redacted(F.col("text"), F.col("secret_spans")).alias("t"))
    assert {r.doc_id: r.t for r in made.collect()} == {0: "é [SECRET], x", 1: None, 2: "plain", 3: "[SECRET]", 4: "[SECRET] end"}
