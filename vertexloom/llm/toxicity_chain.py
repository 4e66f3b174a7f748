"""Toxicity by a classifier chain.

Linear models predict the categories one after another, the last being ``toxic`` as people labelled it. The labels name no other
category, so the earlier ones are degrees of it that follow from the labels and the words: ``repeated`` (toxic, with several
abusive words) and ``dense`` (toxic, with many of them for its length). A later model sees the chances of the earlier categories
beside the words, and the last one, which decides, sees both.

While a later model is trained, the chances it sees are out-of-fold: a fold's terms are chosen and weighed, its degrees are told
and its models are fitted without a document of that fold. Texts that are nearly equal count once, and fall into one fold.
Rows are weighted by how much of their class was drawn, so that chances, and the threshold that out-of-fold chances choose, don't
depend on the size of the sample.
"""

from __future__ import annotations

import dataclasses
import functools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import cut, hidden, map_texts
from vertexloom.llm.quality_crf import class_sizes, training_rows

#: Labelled documents of each class, terms of one fold's models, and folds.
PER_CLASS = 4000
TERMS = 1500
FOLDS = 5
#: The least surely known logarithm of a term's odds.
LEAST_LIFT = 0.7
#: Lengths of the beginnings of words that are terms beside whole words: words are inflected and put together.
BEGINNINGS = (4, 5, 6, 7)
#: How many toxic documents may be missed to leave one more clean one alone, by shares of either.
FALSE_COST = 4.0
#: Words whose terms a worker keeps.
CACHE = 500_000
CATEGORIES = ("repeated", "dense", "toxic")
#: ASCII that parts words.
_PARTS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().translate(_PARTS).split()


def terms(word: str) -> list[str]:
    """A word's terms: itself, and its beginnings, marked by a star."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def support(toxic: int) -> int:
    """How many toxic documents a term needs: the more there are, the more terms meet in some by chance."""
    return max(2, round(toxic**0.5 / 4))


def origin(words: list[str], run: int = 5) -> int:
    """The least hash of the runs of five words: nearly equal texts mostly share it."""
    return min((zlib.crc32(" ".join(words[i : i + run]).encode()) for i in range(max(1, len(words) - run + 1))), default=0)


@dataclasses.dataclass
class Vocabulary:
    """index: column by term. lift: the surely known logarithm of each column's odds."""

    index: dict[str, int]
    lift: np.ndarray


@dataclasses.dataclass
class Chain:
    """models: for each category weights over terms, then of the share and amount of abuse, the earlier chances, and the offset. threshold: least chance of ``toxic`` that counts."""

    vocabulary: Vocabulary
    models: list[np.ndarray]
    threshold: float

    @functools.cached_property
    def known(self) -> dict[str, tuple[int, ...]]:
        return {}


@dataclasses.dataclass
class Found:
    """Terms found in documents: row, column and count of each, and the number of words of each document."""

    rows: np.ndarray
    cols: np.ndarray
    counts: np.ndarray
    words: np.ndarray


def found_in(index: dict[str, int], known: dict[str, tuple[int, ...]], texts: list[str | None]) -> Found:
    """The terms in ``index`` of each text. ``known`` keeps words met before."""
    rows, cols, counts, sizes = [], [], [], []
    for row, text in enumerate(texts):
        words = tokens(text)
        sizes.append(len(words))
        here: Counter = Counter()
        for word, n in Counter(words).items():
            has = known.get(word)
            if has is None:
                if len(known) >= CACHE:
                    known.clear()
                has = known[word] = tuple(index[t] for t in terms(word) if t in index)
            for col in has:
                here[col] += n
        rows += [row] * len(here)
        cols += here.keys()
        counts += here.values()
    return Found(np.array(rows, np.int64), np.array(cols, np.int64), np.array(counts, float), np.array(sizes, float))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 250) -> np.ndarray:
    """Logistic weights over ``width`` binary columns, given as pairs of row and column, and the ``dense`` ones, the last being the offset; rows count by ``weight``."""
    theta = np.zeros(width + dense.shape[1])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    held = np.full(len(theta), ridge)
    held[-1] = 0
    weight = np.ones(len(y)) if weight is None else weight
    for step in range(1, steps + 1):
        pull = weight * (_sigmoid(np.bincount(rows, theta[cols], minlength=len(y)) + dense @ theta[width:]) - y)
        slope = np.append(np.bincount(cols, pull[rows], minlength=width), pull @ dense) / max(1e-9, weight.sum()) + held * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta


def abuse(found: Found, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The amount of abuse in each document, which sums the lifts of its terms, and its share by words."""
    amount = np.bincount(found.rows, vocabulary.lift[found.cols] * found.counts, minlength=len(found.words))
    return amount, amount / np.maximum(found.words, 1)


def _extra(amount: np.ndarray, share: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.log1p(amount), np.minimum(share, 1.0) * 5, *earlier, np.ones(len(amount))], axis=1)


def categories(y: np.ndarray, amount: np.ndarray, share: np.ndarray, marks: tuple[float, float]) -> list[np.ndarray]:
    """The targets in the chain's order; a degree is toxic with more abuse than its mark."""
    return [y * (amount > marks[0]), y * (share > marks[1]), y]


def predict_found(vocabulary: Vocabulary, models: list[np.ndarray], found: Found) -> np.ndarray:
    """A row of chances for each document, a column for each category."""
    width, amount_share = len(vocabulary.lift), abuse(found, vocabulary)
    earlier: list[np.ndarray] = []
    for theta in models:
        earlier.append(_sigmoid(np.bincount(found.rows, theta[found.cols], minlength=len(found.words)) + _extra(*amount_share, earlier) @ theta[width:]))
    return np.stack(earlier, axis=1)


def predict(chain: Chain, texts: list[str | None]) -> np.ndarray:
    return predict_found(chain.vocabulary, chain.models, found_in(chain.vocabulary.index, chain.known, texts))


def _within(found: Found, inside: np.ndarray, columns: np.ndarray) -> Found:
    """The rows ``inside``, with the columns renumbered by ``columns``; those below 0 are left out."""
    kept = inside[found.rows] & (columns[found.cols] >= 0)
    place = np.cumsum(inside) - 1
    return Found(place[found.rows[kept]], columns[found.cols[kept]], found.counts[kept], found.words[inside])


def fit_chain(vocabularies: list[Vocabulary], index: dict[str, int], found: Found, y: np.ndarray, fold: np.ndarray, weight: np.ndarray) -> Chain:
    """The chain from documents whose terms ``found`` are numbered by ``index``.

    ``vocabularies`` are each fold's, made without it, and last the one of all documents. Each link is fitted without each fold
    for the chances that its later links see of that fold, and then on all documents.
    """
    n = len(y)
    columns = []
    for v in vocabularies:
        table = np.full(max(1, len(index)), -1)
        for term, col in v.index.items():
            table[index[term]] = col
        columns.append(table)
    inside = [fold != k for k in range(FOLDS)] + [np.ones(n, bool)]
    parts = [_within(found, inside[k], columns[k]) for k in range(FOLDS + 1)]
    outer = [_within(found, ~inside[k], columns[k]) for k in range(FOLDS)]
    targets, amounts = [], []
    for k in range(FOLDS + 1):
        amount, share = abuse(parts[k], vocabularies[k])
        bad = y[inside[k]] > 0
        marks = tuple(float(np.median(v[bad])) if bad.any() else 0.0 for v in (amount, share))
        amounts.append((amount, share))
        targets.append(categories(y[inside[k]], amount, share, marks))
    chances = np.zeros((n, len(CATEGORIES)))  # out-of-fold
    models: list[list[np.ndarray]] = [[] for _ in range(FOLDS + 1)]
    for link in range(len(CATEGORIES)):
        for k in range(FOLDS + 1):
            dense = _extra(*amounts[k], [chances[inside[k], j] for j in range(link)])
            models[k].append(fit_linear(parts[k].rows, parts[k].cols, dense, targets[k][link], len(vocabularies[k].lift), weight[inside[k]]))
        for k in range(FOLDS):
            if not inside[k].all():
                chances[~inside[k], link] = predict_found(vocabularies[k], models[k], outer[k])[:, link]
    return Chain(vocabularies[-1], models[-1], best_threshold(chances[:, -1], y, weight))


def best_threshold(chance: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold between 0.1 and 0.9 that is best on out-of-fold chances: toxic documents caught less ``FALSE_COST`` times clean ones claimed, by shares; the middle of equals."""
    marks = np.arange(0.1, 0.901, 0.02)
    bad, fine = weight * y, weight * (1 - y)
    gain = np.array([(bad * (chance >= m)).sum() / max(bad.sum(), 1e-9) - FALSE_COST * (fine * (chance >= m)).sum() / max(fine.sum(), 1e-9) for m in marks])
    return float(np.median(marks[gain >= gain.max() - 1e-12]))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Chain | None:
    """The chain fitted on a bounded sample of labelled rows; None unless both labels occur.

    Of sampled texts that are nearly equal and have one label, one is used. Terms are counted on the executors; the driver gets ``TERMS`` of them at
    most for each fold and for all, and for each sampled row the terms it has.
    """
    sizes = class_sizes(labels, "toxic", id_col=id_col)
    if min(sizes) == 0:
        return None
    sample = training_rows(docs, labels, "toxic", per_class, id_col=id_col, text_col=text_col)

    def with_origin(rows: pa.RecordBatch) -> dict:
        return {name: rows.column(name) for name in ("y", "text")} | {"origin": [origin(tokens(t)) for t in rows.column("text").to_pylist()]}

    once = map_texts(sample.select("y", "text"), with_origin, "y int, text string, origin bigint", "text").groupBy("y", "origin").agg(F.min("text").alias("text"))
    once = cut(once.withColumn("fold", F.pmod(F.xxhash64("origin"), F.lit(FOLDS)).cast("int")))

    def listed(rows: pa.RecordBatch) -> dict:
        counts: Counter = Counter()
        for y, fold, text in zip(*(rows.column(c).to_pylist() for c in ("y", "fold", "text")), strict=True):
            counts.update({(t, y, fold) for w in set(tokens(text)) for t in terms(w)})
        keys = list(counts)
        return {"term": [k[0] for k in keys], "y": [k[1] for k in keys], "fold": [k[2] for k in keys], "n": list(counts.values())}

    in_fold = {(r.y, r.fold): r["count"] for r in once.groupBy("y", "fold").count().collect()}
    drawn = [sum(n for (y, _), n in in_fold.items() if y == label) for label in (0, 1)]
    if min(drawn) == 0:
        return None
    of = lambda y, k: F.sum(F.when((F.col("y") == y) & (F.col("fold") != k), F.col("n")).otherwise(0))
    tallies = [of(y, k).alias(f"{name}_{k}") for k in range(FOLDS + 1) for y, name in ((0, "fine"), (1, "bad"))]
    counted = cut(map_texts(once.select("y", "fold", "text"), listed, "term string, y int, fold int, n bigint", "text").groupBy("term").agg(*tallies).filter(F.col(f"bad_{FOLDS}") >= 2))
    chosen = []
    for k in range(FOLDS + 1):
        n0, n1 = (max(1, drawn[y] - in_fold.get((y, k), 0)) for y in (0, 1))
        bad, fine = F.col(f"bad_{k}"), F.col(f"fine_{k}")
        lift = F.log((bad + 0.5) / (n1 + 1)) - F.log((fine + 0.5) / (n0 + 1)) - 1.64 * F.sqrt(1 / (bad + 0.5) + 1 / (fine + 1))
        rated = counted.select("term", lift.alias("lift"), bad.alias("bad")).filter((F.col("bad") >= support(n1)) & (F.col("lift") > LEAST_LIFT))
        chosen.append(rated.orderBy(F.desc(F.col("bad") * F.col("lift")), "term").limit(TERMS).select(F.lit(k).alias("k"), "term", "lift"))
    best = sorted((r.k, r.term, r.lift) for r in functools.reduce(DataFrame.unionAll, chosen).collect())
    vocabularies = []
    for k in range(FOLDS + 1):
        own = [(t, x) for i, t, x in best if i == k]
        vocabularies.append(Vocabulary({t: i for i, (t, _) in enumerate(own)}, np.array([x for _, x in own], float)))
    index = {t: i for i, t in enumerate(sorted({t for _, t, _ in best}))}

    def held(rows: pa.RecordBatch) -> dict:
        f = found_in(index, {}, rows.column("text").to_pylist())
        cuts = np.searchsorted(f.rows, np.arange(1, len(f.words)))
        return {"origin": rows.column("origin"), "y": rows.column("y"), "fold": rows.column("fold"), "cols": np.split(f.cols, cuts), "counts": np.split(f.counts, cuts), "words": f.words}

    got = sorted(map_texts(once, held, "origin bigint, y int, fold int, cols array<bigint>, counts array<double>, words double", "text").collect())
    found = Found(np.repeat(np.arange(len(got)), [len(r.cols) for r in got]), np.array([c for r in got for c in r.cols], np.int64), np.array([c for r in got for c in r.counts], float), np.array([r.words for r in got]))
    y, fold = np.array([r.y for r in got], float), np.array([r.fold for r in got])
    weight = np.where(y > 0, sizes[1] / drawn[1], sizes[0] / drawn[0])
    return fit_chain(vocabularies, index, found, y, fold, weight / weight.mean())


def _scored(rows: DataFrame, chain: Chain | None, text: str) -> DataFrame:
    """``rows``, whose names don't clash, and the chain's chances."""

    def scored(part: pa.RecordBatch) -> dict:
        texts = part.column(text).to_pylist()
        made = predict(chain, texts) if chain is not None and texts else np.zeros((len(texts), len(CATEGORIES)))
        return {name: part.column(name) for name in part.schema.names} | {f"chain_{k}": made[:, i] for i, k in enumerate(CATEGORIES)}

    return map_texts(rows, scored, ", ".join([*(f"`{name}` {kind}" for name, kind in rows.dtypes), *(f"chain_{k} double" for k in CATEGORIES)]), text)


def _toxic(chain: Chain | None) -> Column:
    return F.col("chain_toxic") >= (1.0 if chain is None else chain.threshold)


def score(docs: DataFrame, chain: Chain | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, p_repeated, p_dense, p_toxic, toxic`` of every row: the chain's chances, and 1 if the last of them reaches the chain's threshold.

    A null text counts as empty. Without labels of both kinds every chance is 0. Repeated rows stay repeated; an empty table gives
    no rows; other columns are left out.
    """
    out = _scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), chain, "text")
    return out.select("doc_id", *(F.col(f"chain_{k}").alias(f"p_{k}") for k in CATEGORIES), _toxic(chain).cast("int").alias("toxic"))


def keep_clean(docs: DataFrame, chain: Chain | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns."""
    out = _scored(hidden(docs), chain, f"kept_{docs.columns.index(text_col)}")
    return out.filter(~_toxic(chain)).drop(*(f"chain_{k}" for k in CATEGORIES)).toDF(*docs.columns)
