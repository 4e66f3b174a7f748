import random
from collections import defaultdict

import numpy as np
import pytest

from vertexloom.llm import prob_minhash as P

from .conftest import prose


def changed(text, every):
    return " ".join("zzz" if i % every == every - 1 else w for i, w in enumerate(text.split()))


def edited(words, places, tag):
    return [f"{tag}{i}" if i in places else w for i, w in enumerate(words)]


def plain_classes(texts):
    """Union of all pairs that are similar enough, by comparing every two texts that are equal or share a shingle."""
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: P.weighted_shingles(t) for i, t in texts.items()}
    ids = sorted(texts)
    having, equal = defaultdict(list), defaultdict(list)
    for a in ids:
        meets = {b: texts[a] == texts[b] for b in {*equal[texts[a]], *(b for k in sets[a][0].tolist() for b in having[k])}}
        for b, same in meets.items():
            if root(a) != root(b) and (same or P.probability_jaccard(sets[a], sets[b]) >= 0.8):
                parent[max(root(a), root(b))] = min(root(a), root(b))
        equal[texts[a]].append(a)
        for k in sets[a][0].tolist():
            having[k].append(a)
    return {i: root(i) for i in ids}


def test_shingles_and_weights():
    k, w = P.weighted_shingles("a b c d e a b c d e a b c d e")
    assert len(k) == 5 and sorted(w) == pytest.approx(sorted(1 + np.log([3, 2, 2, 2, 2])))
    assert len(P.weighted_shingles("one two")[0]) == 1 and len(P.weighted_shingles(None)[0]) == 0


def test_registers_estimate_the_probability_jaccard():
    a, b = P.weighted_shingles(prose(1, 300)), P.weighted_shingles(changed(prose(1, 300), 40))
    exact = P.probability_jaccard(a, b)
    many = np.mean(P.signature(*a, 4096 // 2) == P.signature(*b, 4096 // 2))
    assert abs(many - exact) < 4 * (exact * (1 - exact) / 2048) ** 0.5
    weighted = (np.array([1, 2, 3], np.uint64), np.array([5.0, 1, 1])), (np.array([1, 2, 4], np.uint64), np.array([1.0, 1, 1]))
    exact = P.probability_jaccard(*weighted)
    assert exact == pytest.approx(1 / (1 + 1 + 1 / 5 + 1) + 1 / (5 + 1 + 1 + 1))
    agree = np.mean([np.mean(P.signature(x[0] * np.uint64(s) + np.uint64(s), x[1]) == P.signature(y[0] * np.uint64(s) + np.uint64(s), y[1])) for s in range(1, 61) for x, y in [weighted]])
    assert abs(agree - exact) < 0.03


def test_early_end_changes_nothing(monkeypatch):
    k, w = P.weighted_shingles(prose(5, 200))
    want = np.zeros(P.REGISTERS, np.uint64)
    best = np.full(P.REGISTERS, np.inf)
    for key, weight in zip(k, w, strict=True):
        h = P._mix(key + np.arange(1, 400, dtype=np.uint64) * P._GOLDEN)
        t = np.cumsum(-np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight)
        for time, place in zip(t, (h & np.uint64(0x7FF)) * np.uint64(P.REGISTERS) >> np.uint64(11), strict=True):
            if time < best[int(place)]:
                best[int(place)], want[int(place)] = time, key
    assert (P.signature(k, w) == want).all()


def test_classes_agree_with_all_pairs(spark):
    texts = {}
    for s in range(12):
        t = prose(100 + s, 60 + 10 * s)
        texts |= {s * 10: t, s * 10 + 1: changed(t, 60), s * 10 + 2: t, s * 10 + 3: changed(t, 8), s * 10 + 4: t.replace(" ", "  "), s * 10 + 5: changed(changed(t, 60), 47)}
    texts |= {900: "", 901: "", 902: " ", 903: "a b", 904: "a  b", 905: "a c"}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, band string")
    got = {r.doc_id: r.class_id for r in P.near_duplicates(df).collect()}
    assert got == plain_classes(texts)


def test_a_large_group_and_a_shared_passage(spark):
    passage = prose(77, 55)
    rows = [(i, prose(1, 80) + f" end{i % 7}") for i in range(300)] + [(1000 + i, passage + " " + prose(2000 + i, 40)) for i in range(60)]
    got = defaultdict(set)
    for r in P.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.class_id].add(r.doc_id)
    assert got[0] == set(range(300)) and all(len(v) == 1 for k, v in got.items() if k >= 1000)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    assert {r.id: r.component for r in P.components(edges).collect()} == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_odd_texts(odd, none):
    rows = P.near_duplicates(odd).collect()
    got = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == odd.count() and got[0] == got[1] == 0 and got[4] == got[5] == 4 and got[3] == 3 and P.near_duplicates(none).count() == 0


def test_a_link_whose_buckets_all_have_other_heads(spark):
    r, base = random.Random(1025), prose(1025, 300).split()
    pick = lambda k: r.sample(range(3, 297, 6), k)
    texts = {i: " ".join(edited(base, pick(5), f"m{i}w")) for i in range(30)}
    x = edited(base, pick(3), "x")
    texts |= {90: " ".join(x), 91: " ".join(edited(x, pick(6), "y"))}
    got = {r.doc_id: r.class_id for r in P.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == plain_classes(texts) and got[91] == 90


def test_tiles_find_every_link_however_small(spark, monkeypatch):
    for name, size in (("TILE", 2), ("PAIRED", 3), ("ASKED", 1)):
        monkeypatch.setattr(P, name, size)
    test_a_link_whose_buckets_all_have_other_heads(spark)


def test_a_link_to_a_member_of_the_heads_component(spark):
    """0 heads 1, and 1 is like 2, which isn't like 0."""
    r, base = random.Random(38), prose(38, 300).split()
    places = list(range(3, 297, 6))
    r.shuffle(places)
    x = edited(base, places[:2], "x")
    texts = {0: " ".join(base), 1: " ".join(x), 2: " ".join(edited(x, places[20:26], "y"))}
    like = lambda a, b: P.probability_jaccard(P.weighted_shingles(texts[a]), P.weighted_shingles(texts[b])) >= 0.8
    assert like(0, 1) and like(1, 2) and not like(0, 2)
    got = P.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_bounds_hold_and_are_exact_without_repeats():
    r = random.Random(11)
    sets = []
    for _ in range(40):
        words = prose(r.randrange(5), 40).split()
        sets.append(P.weighted_shingles(" ".join(edited(words, set(r.sample(range(40), r.randrange(6))), "n") + words[: r.randrange(25)])))
    tile = P.Tile()
    for i, s in enumerate(sets):
        tile.add(i, s)
    for a in sets:
        for b, bound in zip(sets, tile.bounds(*a), strict=True):
            exact = P.probability_jaccard(a, b)
            assert bound >= exact - 1e-9
            if (a[1] == 1).all() and (b[1] == 1).all():
                assert bound == pytest.approx(exact)


def test_needed_agreement_leaves_similar_pairs():
    from math import comb

    needed = P.agreement_needed(0.8)
    missed = sum(comb(P.REGISTERS, k) * 0.8**k * 0.2 ** (P.REGISTERS - k) for k in range(needed))
    assert 0 < missed < 1e-5


def test_all_links_of_the_test_table(spark, sf_dir):
    """Classes of the whole table, against all pairs by an inverted index: no link of 0.8 is lost."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in P.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)
