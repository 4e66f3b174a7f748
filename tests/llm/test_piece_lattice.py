import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest

from vertexloom.llm import piece_lattice as L

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def v():
    return L.vocabulary(MODEL)


def every(v, text):
    """All segmentations as (score, cuts), best first."""
    out = []

    def go(at, score, cuts):
        if at == len(text):
            out.append((score, tuple(cuts)))
            return
        for end in range(at + 1, min(len(text), at + v.longest) + 1):
            s = v.score.get(text[at:end], v.unknown if end == at + 1 else None)
            if s is not None:
                go(end, score + s, [*cuts, end])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_n_best_agree_with_enumeration(v):
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("ab the\nn 漢é😀") for _ in range(r.randint(0, 9)))
        want = every(v, L.normalized(text))
        got = L.encode_batch(v, [text], 5)[0]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:5]])
        assert len({tuple(i.tolist()) for _, i in got}) == len(got) and all(L.decode(v, i) == text for _, i in got)


def test_search_of_one_word(v):
    for word in ("▁there", "▁▁a", "xyzzy", "é漢"):
        want = every(v, word)
        got = L.n_best(v, word, 7)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:7]]) and {c for _, c in got} <= {c for _, c in want}


def test_long_words_and_forgetting(v, monkeypatch):
    text = "thethethe" * 9 + " of of the"
    whole = L.encode_batch(v, [text], 3)[0]
    monkeypatch.setattr(L, "BATCH_LENGTH", 0)
    monkeypatch.setattr(L, "KEPT_WORDS", 1)
    again = L.encode_batch(v, [text, "of the"], 3)[0]
    assert [s for s, _ in whole] == pytest.approx([s for s, _ in again]) and whole[0][1].tolist() == again[0][1].tolist()


LONG = """
import random, resource, sys
import public_tokenizers
from vertexloom.llm import piece_lattice as L

v = L.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
r = random.Random(5)
word = "".join(r.choice("etaoinshrdlu") for _ in range(200_000))
ways = L.encode_batch(v, [word], 4)[0]
assert len(ways) == 4 and len({i.tobytes() for _, i in ways}) == 4 and all(L.decode(v, i) == word for _, i in ways)
assert sorted((s for s, _ in ways), reverse=True) == [s for s, _ in ways]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_very_long_word_stays_small():
    """A word of 200,000 letters takes memory in proportion to its length."""
    got = subprocess.run([sys.executable, "-c", LONG], capture_output=True, text=True, timeout=300, check=True)
    assert int(got.stdout) < 500


def test_pieces_across_words(v, monkeypatch):
    """Of a model whose pieces cross words a text is one word, with the same results where none does."""
    texts = ["the of a  the", "", " \n the\nof", "é the漢"]
    want = L.encode_batch(v, texts, 4)
    monkeypatch.setattr(v, "crossing", True)
    assert L.words_of(v, "a b") == ["▁a▁b"]
    got = L.encode_batch(v, texts, 4)
    for a, b in zip(want, got, strict=True):
        assert [s for s, _ in a] == pytest.approx([s for s, _ in b]) and a[0][1].tolist() == b[0][1].tolist()


def test_one_pass_gives_the_second_best(v):
    r = random.Random(2)
    for _ in range(200):
        word = "".join(r.choice("abthe▁n漢é") for _ in range(r.randint(1, 9)))
        scores = [s for s, _ in every(v, word)] + [-np.inf]
        best, second, _ = L.forward(L.lattice(v, word))
        assert best[-1] == pytest.approx(scores[0]) and second[-1] == pytest.approx(scores[1])
        score, loss, lengths, begin, flat = L.forward_batch(v, [word, word])
        assert score[1] == pytest.approx(scores[0]) and loss[0] == pytest.approx(scores[0] - scores[1])
        assert flat[begin[1] : begin[1] + lengths[1]].tolist() == L.cuts_to_ids(v, word, L.best_cuts(v, word))


def test_bytes_stand_for_unknown_characters(v):
    assert L.cuts_to_ids(v, "Ａ", (1,)) == [v.bytes[b] for b in "Ａ".encode()]
    assert L.decode(v, L.cuts_to_ids(v, "▁Ａ\n", (1, 2, 3))) == "Ａ\n"


def test_odd_texts(odd, none):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = L.encode(odd, MODEL, n=3).collect()
    assert {r.doc_id for r in rows} == set(texts) and L.encode(none, MODEL).count() == 0
    for r in rows:
        assert r.round_trip and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) and r.n_pieces == len(r.ids)
        assert L.decode(L.vocabulary(MODEL), r.ids) == texts[r.doc_id]
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.rank, r.score))
    assert all(all(a[1] >= b[1] for a, b in zip(sorted(x), sorted(x)[1:])) for k, x in by_doc.items() if k != 4)
    assert by_doc[0] == by_doc[1] == [(1, 0.0)] and len(by_doc[4]) == 6
