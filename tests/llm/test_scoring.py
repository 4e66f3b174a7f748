"""Quality and toxicity: sums against enumeration, held-out accuracy, odd tables."""

import itertools

import numpy as np

from vertexloom.llm import quality_crf as Q
from vertexloom.llm import toxicity_chain as C

from .conftest import prose


def test_marginals_agree_with_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([1, 4, 3])
    scores, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    good, expected = Q.marginals(scores, moves, counts, pairs=True)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in counts:
        mass, one, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(scores[at + i] * y for i, y in enumerate(labels)) + sum(moves[a, b] for a, b in itertools.pairwise(labels)))
            mass += w
            one += w * np.array(labels)
            for a, b in itertools.pairwise(labels):
                pairs[a, b] += w
        assert np.allclose(good[at : at + n], one / mass)
        want_pairs += pairs / mass
        at += n
    assert np.allclose(expected, want_pairs)


def test_features_cover_each_line():
    x, size, counts = Q.line_features(["", "ab\n\nC D", "é|é"])
    assert counts.tolist() == [1, 3, 1] and size.tolist() == [0, 2, 0, 3, 3] and x.shape == (5, Q.OWN)
    wide = Q.with_neighbours(x, counts)
    assert wide.shape == (5, Q.WIDTH) and (wide[1, Q.OWN : 2 * Q.OWN - 2] == 0).all()


def test_quality_held_out(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.score(docs, Q.fit(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 40 and (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_on_odd_tables(odd, none, odd_labels):
    for field in (Q.fit(odd, odd_labels, per_class=5), None):
        got = Q.score(odd, field).toPandas()
        assert len(got) == odd.count() and got.score.between(0, 1).all()
        assert got[got.doc_id == 4].score.nunique() == 1 and ((got.score >= 0.3) == got.predicted).all()
        kept = Q.keep_good(odd, field)
        assert kept.columns == odd.columns and kept.count() == got.predicted.sum()
    assert Q.fit(none, odd_labels) is None and Q.score(none, None).count() == 0


def test_held_out_rows_are_never_learned(spark):
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    rows = Q.training_rows(docs, labels, "quality", 1000, id_col="doc_id", text_col="text", held_in=~Q.held_out())
    import zlib

    assert {r.doc_id for r in rows.collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}


def test_chain_feeds_earlier_chances():
    words = C.Vocabulary({"bad": 0}, np.array([2.0]))
    chain = C.Chain(words, [np.array([4.0, 0, 0, -2]), np.array([0, 0, 0, 3.0, -2]), np.array([0, 1.0, 0.5, 0, 3.0, -2])], 0.5)
    p = C.predict(chain, ["a bad day, a BAD night", "a day", None])
    first = 1 / (1 + np.exp(-np.array([2.0, -2, -2])))
    second = 1 / (1 + np.exp(-(3 * first - 2)))
    amount, share = np.array([4.0, 0, 0]), np.array([4 / 6, 0, 0])
    assert np.allclose(p[:, 0], first) and np.allclose(p[:, 1], second)
    assert np.allclose(p[:, 2], 1 / (1 + np.exp(-(np.log1p(amount) + 2.5 * share + 3 * second - 2))))


def test_folds_know_nothing_of_their_own(spark, monkeypatch):
    """Every fold's terms and lifts are those that a plain count over the other folds gives; texts that are nearly equal count once."""
    rows = [(i, prose(i, 40) + (" nitwit" if i % 3 == 0 else "") + f" rare{i // 12}", int(i % 3 == 0)) for i in range(240)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen = {}
    fit_chain = C.fit_chain
    monkeypatch.setattr(C, "fit_chain", lambda v, *rest: seen.update(v=v, fold=rest[3], y=rest[2]) or fit_chain(v, *rest))
    assert C.fit(docs, labels) is not None
    once = {}
    for _, t, y in rows:
        key = (y, C.origin(C.tokens(t)))
        once[key] = min(t, once.get(key, t))
    folds = {r.o: r.f for r in spark.createDataFrame([(o,) for _, o in once], "o long").selectExpr("o", f"int(pmod(xxhash64(o), {C.FOLDS})) f").collect()}
    assert len(seen["y"]) == len(once) and sorted(seen["fold"]) == sorted(folds[o] for _, o in once)
    for k, v in enumerate(seen["v"]):
        counts, n = [{}, {}], [0, 0]
        for (y, o), t in once.items():
            if folds[o] != k:
                n[y] += 1
                for term in {x for w in C.tokens(t) for x in C.terms(w)}:
                    counts[y][term] = counts[y].get(term, 0) + 1
        want = {}
        for term, bad in counts[1].items():
            fine = counts[0].get(term, 0)
            lift = np.log((bad + 0.5) / (n[1] + 1)) - np.log((fine + 0.5) / (n[0] + 1)) - 1.64 * np.sqrt(1 / (bad + 0.5) + 1 / (fine + 1))
            if bad >= C.support(n[1]) and lift > C.LEAST_LIFT:
                want[term] = lift
        assert set(v.index) == set(want) and all(abs(v.lift[v.index[t]] - x) < 1e-9 for t, x in want.items())
        assert "nitwit" in v.index


def test_threshold_is_best_on_given_chances():
    rng = np.random.default_rng(3)
    y = (rng.random(500) < 0.3).astype(float)
    chance, weight = np.clip(0.3 * y + rng.random(500) * 0.7, 0, 1), np.where(y > 0, 1.0, 4.0)
    got = C.best_threshold(chance, y, weight)
    gain = lambda m: (y * (chance >= m)).sum() / y.sum() - C.FALSE_COST * ((1 - y) * (chance >= m)).sum() / (1 - y).sum()
    assert gain(got) >= max(gain(m) for m in np.arange(0.1, 0.9, 0.02)) - 0.02


def test_toxicity_held_out_on_documents(spark, sf_dir):
    """Scored on a fifth that was never learned, whatever the size of the sample."""
    from pyspark.sql import functions as F

    d = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    mine = Q.held_out()
    for per_class in (C.PER_CLASS, 300):
        chain = C.fit(docs, labels.filter(~mine), per_class=per_class)
        got = C.score(docs.filter(mine), chain).withColumnRenamed("toxic", "found").join(labels, "doc_id").groupBy("toxic").agg(F.avg("found")).collect()
        shares = {r[0]: r[1] for r in got}
        # A few labelled documents were later replaced by junk in which no abusive word is left.
        assert shares[1] > 0.9 and shares[0] < 0.02


def test_toxicity_generalises(spark):
    """Fitted on two thirds, it finds the toxic documents among the rest."""
    rows = [(i, prose(i, 80) + (" you utter " + ["nitwit", "dolt", "blockhead"][i % 3] if i % 4 == 0 else "") + " end", int(i % 4 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 5], "doc_id long, quality int, toxic int")
    chain = C.fit(docs, labels)
    got = C.score(docs, chain).toPandas().set_index("doc_id")
    assert all(got.toxic[i] == y for i, _, y in rows)
    kept = C.keep_clean(docs, chain)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, y in rows if not y}


def test_toxicity_on_odd_tables(odd, none, odd_labels):
    for chain in (C.fit(odd, odd_labels), None):
        got = C.score(odd, chain).toPandas()
        assert len(got) == odd.count() and got.filter(like="p_").to_numpy().min() >= 0
    assert C.fit(none, odd_labels) is None and C.score(none, None).count() == 0
