import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vertexloom.llm import packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_decompose(n):
    parts = packing.decompose(n)
    assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p & (p - 1) == 0 and p <= 1024 for p in parts)
    assert all(parts.count(p) == 1 for p in set(parts) - {1024})


@pytest.mark.parametrize("ranks", [RANKS, None])
def test_pieces_of_odd_texts(odd, ranks):
    t = Tokenizer.from_file(JSON)
    pieces = defaultdict(list)
    rows = packing.pack(odd, JSON, ranks).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    for r in rows:
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32
        pieces[r.doc_id].append(r)
    for doc, group in odd.toPandas().groupby("doc_id", dropna=False):
        doc = None if doc != doc else int(doc)
        want = [*t.encode(group.text.iloc[0] or "", add_special_tokens=False).ids, 0]
        got = sorted(pieces[doc], key=lambda r: (r.start, r.sequence_id))[:: len(group)]
        assert [i for r in got for i in r.ids] == want and {r.doc_tokens for r in got} == {len(want)}


def test_fast_ids_are_the_tokenizer_s(spark, sf_dir):
    t, encode = Tokenizer.from_file(JSON), packing.encoder(JSON, RANKS)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        assert encode(r.text) == t.encode(r.text, add_special_tokens=False).ids
    for text in ("a b　  c\t\n\n d", "don't I'LL we've", "naïve Ünï ½ ² ٣ 漢字", "​́x", "  " * 500):
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def test_empty_table_and_bad_limit(none):
    assert packing.pack(none, JSON, RANKS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, JSON, limit=1000)


@pytest.mark.parametrize("text", [" " * 1_000_000, " " * 300_000 + "end", "\n" * 100_000, "x" * 100_000, "日本語" * 20_000, "7" * 50_000, "#$%" * 20_000, "\t \u3000" * 20_000, "a" + "\u0301" * 20_000, "<|endoftext|>" + " " * 200_000])
def test_long_runs(text):
    """What makes the faster library panic, or might, has the ids of the tokenizer."""
    assert packing.encoder(JSON, RANKS)(text) == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


def test_repeated_ids_are_spread(spark, monkeypatch):
    """Rows that share an id, or have none, don't share a window."""
    monkeypatch.setattr(packing, "GROUPS", 16)
    df = spark.createDataFrame([(i, "a b") for i in [None] * 300 + [7] * 300], "doc_id long, text string")
    rows = packing.pack(df, JSON, RANKS).collect()
    lanes = packing.CONTEXT.bit_length()
    assert len({r.sequence_id for r in rows}) == len(rows) == 1200
    assert len({r.sequence_id // lanes % 16 for r in rows if r.doc_id is None}) == 16
