import hashlib

from pyspark.sql import functions as F

from vertexloom.llm import order_minhash as O

from .conftest import prose


def signatures(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return {r.i: r.s for r in O.add_signature(df, F.col("t"), "s").collect()}


def like(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / O.SKETCHES


def plain(spark, text):
    """The signature by its definition, with Spark's hash for the only borrowed part."""
    import re

    hashes = {}

    def h(*values):
        if values not in hashes:
            hashes[values] = spark.range(1).select(F.xxhash64(*(F.lit(v) if isinstance(v, str) else F.lit(v).cast("long") for v in values)).alias("h")).first().h
        return hashes[values]

    words = [h(w) for w in re.findall(r"(?<!\S)\S{1,16}(?!\S)|\S", text)]
    grams = [h(*(words[i + j] if i + j < len(words) else None for j in range(3))) & O._HASHES for i in range(max(len(words) - 2, 1))]
    seen, found = {}, []
    for place, g in enumerate(grams):
        n = seen[g] = seen.get(g, -1) + 1
        found.append(((g if n == 0 else _num(h, g, n)) & O._HASHES, place))
    out = []
    for circle in range(O.CIRCLES):
        here = [(h2(h, e, circle) & O._HASHES if circle else e, place) for e, place in found]
        for j in range(O.POINTS):
            point = (j << 64) // O.POINTS - (1 << 63)
            order = sorted(here, key=lambda e: ((e[0] - point) % (1 << 64), e[1]))
            pair = sorted((order[0], order[1 % len(order)]), key=lambda e: e[1])
            out.append(h(pair[0][0], pair[1][0]) & 0x7FFFFFFF)
    return out


def h2(h, element, circle):
    return _num(h, element, circle)


def _num(h, g, n):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().range(1).select(F.xxhash64(F.lit(g).cast("long"), F.lit(n).cast("int")).alias("h")).first().h


def test_against_the_definition(spark):
    for text in ("one two three four five six seven", "a b a b a b a b c", "only two", "x", "", "one aaaabbbbccccddddee two", "日本語の文章は空白なしで続くのであるから"):
        assert signatures(spark, [text])[0] == plain(spark, text), text


def test_order_matters(spark):
    a = prose(1, 400)
    words = a.split()
    near = " ".join([*words[:-3], "other", "words", "here"])
    turned = " ".join(words[300:] + words[200:300] + words[100:200] + words[:100])
    s = signatures(spark, [a, a, near, turned, prose(2, 400), None, ""])
    assert s[0] == s[1] and s[5] == s[6] and all(len(x) == O.SKETCHES for x in s.values())
    assert like(s[0], s[2]) > 0.9 > like(s[0], s[3]) > like(s[0], s[4])


def test_an_edit_in_a_spaceless_text(spark):
    """One character put in front of, or into, a long run changes little; another text stays unlike."""
    import random

    r = random.Random(4)
    run = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    a = run(2000)
    s = signatures(spark, [a, "q" + a, a[:1000] + "q" + a[1000:], run(2000), "日本語" * 700, "語" + "日本語" * 700])
    assert like(s[0], s[1]) > 0.8 and like(s[0], s[2]) > 0.8 and like(s[0], s[3]) < 0.2 and like(s[4], s[5]) > 0.8


def test_sketches_vary_as_independent_ones(spark):
    """Over many pairs of texts the likeness varies about as that of 64 independent sketches would: J(1 - J)/64."""
    import random

    import numpy as np

    r = random.Random(7)
    texts = []
    for _ in range(150):
        words = [f"w{r.randrange(10**9)}" for _ in range(300)]
        texts += [" ".join(words), " ".join(words[:200] + [f"x{r.randrange(10**9)}" for _ in range(100)])]
    s = signatures(spark, texts)
    got = np.array([like(s[2 * i], s[2 * i + 1]) for i in range(150)])
    mean = got.mean()
    assert 0.15 < mean < 0.4 and got.var() < 1.5 * mean * (1 - mean) / O.SKETCHES
    short = [f"w{i}a w{i}b w{i}c w{i}d w{i}e w{i}f" for i in range(20)]
    assert np.mean([len(set(x)) for x in signatures(spark, short).values()]) >= 4


def test_places_are_exact(spark):
    """The place of an element is kept whole, however far into the text."""
    e = spark.createDataFrame([(5, (1 << 31) - 9)], "h long, at long").select(O._hash_of((F.col("h") * (1 << 40)).bitwiseOR(F.col("at"))).alias("h"), O._place_of((F.col("h") * (1 << 40)).bitwiseOR(F.col("at"))).alias("p")).first()
    assert (e.h, e.p) == (5 << 40, (1 << 31) - 9)


def test_following_ids(spark):
    ids = [3, 4, 4095, 4096, 70_000_000_000, 5, -7, 9_000_000, 9_000_001, *(i * 987_654_321_987 for i in range(1, 200))]
    got = {r.id: r.next_id for r in O.following(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    order = sorted(ids)
    assert got == dict(zip(order, [*order[1:], None], strict=True))


def test_edits_of_odd_texts(odd, none):
    rows = O.edited_pairs(odd).collect()
    assert len(rows) == odd.count() and O.edited_pairs(none).count() == 0
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    order = sorted(k for k in texts if k is not None)
    for r in rows:
        t = texts[r.doc_id]
        after = texts[order[(order.index(r.doc_id) + 1) % len(order)]] if r.doc_id is not None else ""
        assert r.n_chars == len(t) and r.edited == t[: len(t) - len(t) // 2] + after[: len(t) // 2]


def test_the_query_on_the_test_table(spark, sf_dir):
    from vertexloom.llm.queries import QUERIES

    got = QUERIES["op8_order_minhash"](spark, sf_dir).toPandas().set_index("doc_id").sort_index()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    texts = list(docs.text)
    for i, (doc, t) in enumerate(zip(docs.doc_id, texts, strict=True)):
        e = t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2]
        assert got.edited_sha256[doc] == hashlib.sha256(e.encode()).hexdigest()
    assert (got.near_edited > got.near_next).mean() > 0.9 and got.fingerprint.groupby(texts).nunique().max() == 1
