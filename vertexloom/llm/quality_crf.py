"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's score is linear in its own features and in those of the lines before and after it;
a 2 by 2 table scores neighbouring labels. Forward-backward sums give each line's chance of being good, their mean weighted by
line length gives the document's, and a logistic curve fitted on the training documents turns that into the score.

Only documents carry labels. Lines begin with their document's label; in bad documents, lines that the field then finds good
are relabelled, one bad line staying at least, and the field is fitted again.
"""

from __future__ import annotations

import dataclasses
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import cut, hidden, map_texts

#: Labelled documents of each class that the field is fitted on, and lines in one training sequence.
PER_CLASS = 2000
TRAIN_LINES = 64
THRESHOLD = 0.3
OWN = 15
#: Own features that are also seen for the lines before and after.
SHARED = slice(2, OWN)
WIDTH = OWN + 2 * (OWN - 2) + 2


def _classes() -> np.ndarray:
    """Bits by code point below 0x3000: 1 letter, 2 upper case, 4 digit, 8 symbol, 16 space."""
    kinds = np.zeros(0x3000, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        kinds[i] = c.isalpha() + 2 * c.isupper() + 4 * c.isdigit() + 16 * c.isspace()
        if not kinds[i] and c not in ".,;:'\"()-?" and c.isprintable():
            kinds[i] = 8
    return kinds


_KINDS: list[np.ndarray] = []


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of every line of every text, the lines' lengths in code points, and the number of lines of each text."""
    if not _KINDS:
        _KINDS.append(_classes())
    counts = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kinds = np.where(points < 0x3000, _KINDS[0][np.minimum(points, 0x2FFF)], np.uint8(1))
    ends = np.append(np.flatnonzero(points == 10), len(points))
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(points) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[ends] - sums[starts]

    letters, upper, digits, symbols = (total(kinds & bit > 0) for bit in (1, 2, 4, 8))
    words, unique, repeated, bare = (np.zeros(len(ends)) for _ in range(4))
    for i, line in enumerate(joined.split("\n")):
        parts = line.split()
        if parts:
            words[i], unique[i] = len(parts), len(set(parts))
            repeated[i] = sum(map(operator.eq, parts, parts[1:]))
            bare[i] = parts.count("|")
    n, w = np.maximum(size, 1), np.maximum(words, 1)
    last = np.where(size > 0, points[np.maximum(ends - 1, 0)] if len(points) else 0, 0)
    shout, strange, again, few = upper / np.maximum(letters, 1), symbols / n, repeated / w, unique / w
    x = np.stack([
        np.ones(len(ends)), np.log1p(size) / 10, shout, strange, digits / n, bare / w, again, few, np.minimum(letters / w, 20) / 10,
        np.isin(last, [46, 33, 63]), shout > 0.5, strange > 0.06, again > 0.25, (few < 0.5) & (words >= 8), size == 0,
    ], axis=1).astype(np.float32)
    return x, size, counts


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Adds the features of the lines before and after, and whether there is none; zeros beyond a document's ends."""
    ends = np.cumsum(counts)
    first, final = np.zeros(len(x), bool), np.zeros(len(x), bool)
    first[ends - counts], final[ends - 1] = True, True
    before, after = np.roll(x[:, SHARED], 1, axis=0), np.roll(x[:, SHARED], -1, axis=0)
    before[first], after[final] = 0, 0
    return np.concatenate([x, before, after, first[:, None], final[:, None]], axis=1, dtype=np.float32)


@dataclasses.dataclass
class Field:
    """weights: of a good line's features. moves: [label before, label], 0 bad and 1 good. curve: slope and offset of the score."""

    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float]


def _softplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(scores: np.ndarray, moves: np.ndarray, counts: np.ndarray, pairs: bool = False):
    """Each line's chance of being good by forward-backward sums, all documents stepped together, the longest first.

    With ``pairs`` also the expected counts of neighbouring labels, 2 by 2, over all documents, and the sum of log partitions.
    """
    order = np.argsort(-counts, kind="stable")
    sizes, begin = counts[order], (np.cumsum(counts) - counts)[order]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), "left")  # documents with more than t lines
    forward, backward = np.zeros((len(scores), 2)), np.zeros((len(scores), 2))
    for t in range(steps):
        rows = begin[: alive[t]] + t
        if t:
            old = forward[rows - 1]
            forward[rows] = _softplus(old[:, :1] + moves[0], old[:, 1:] + moves[1])
        forward[rows, 1] += scores[rows]
    for t in reversed(range(steps - 1)):
        rows = begin[: alive[t + 1]] + t
        new = backward[rows + 1] + np.stack([np.zeros(len(rows)), scores[rows + 1]], axis=1)
        backward[rows] = np.stack([_softplus(moves[a, 0] + new[:, 0], moves[a, 1] + new[:, 1]) for a in (0, 1)], axis=1)
    both = forward + backward
    total = _softplus(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    if not pairs:
        return good
    expected = np.zeros((2, 2))
    inner = np.ones(len(scores), bool)
    inner[np.cumsum(counts) - counts] = False
    rows = np.flatnonzero(inner)
    for a in (0, 1):
        for b in (0, 1):
            expected[a, b] = np.exp(forward[rows - 1, a] + moves[a, b] + b * scores[rows] + backward[rows, b] - total[rows]).sum()
    return good, expected


def fit_lines(x: np.ndarray, counts: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves of the field that make the labels ``y`` likeliest, by Adam on the exact gradient."""
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(counts) - counts] = False
    rows = np.flatnonzero(inner)
    seen = np.bincount(2 * y[rows - 1].astype(int) + y[rows].astype(int), minlength=4).reshape(2, 2)
    for step in range(1, steps + 1):
        weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
        good, expected = marginals(x @ weights, moves, counts, pairs=True)
        slope = np.append((good - y) @ x, (expected - seen).ravel()) / max(1, len(y)) + ridge * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def document_means(good: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means of the lines' chances, weighted by length; each line counts one at least."""
    at = np.cumsum(counts) - counts
    weight = np.maximum(size, 1)
    return np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)


def fit_curve(means: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's steps, lightly held back."""
    a = np.zeros(2)
    z = np.stack([means - 0.5, np.ones(len(means))], axis=1)
    hold = np.diag([1e-2, 1e-4])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ a))
        a = a + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold, z.T @ (labels - p) - hold @ a)
    return float(a[0]), float(a[1])


def train(documents: list[tuple[np.ndarray, np.ndarray, int]]) -> Field | None:
    """Fits the field on (own features, line lengths, label) of documents; None unless both labels occur."""
    labels = np.array([y for *_, y in documents])
    if len(set(labels.tolist())) < 2:
        return None
    parts = [(x[i : i + TRAIN_LINES], y) for x, _, y in documents for i in range(0, len(x), TRAIN_LINES)]
    part_counts = np.array([len(x) for x, _ in parts])
    x = with_neighbours(np.concatenate([x for x, _ in parts]), part_counts)
    truth = np.repeat([y for _, y in parts], part_counts).astype(float)
    y, at = truth.copy(), np.cumsum(part_counts) - part_counts
    for round_ in range(3):
        weights, moves = fit_lines(x, part_counts, y)
        good = marginals(x @ weights, moves, part_counts)
        if round_ < 2:
            worst = np.repeat(np.minimum.reduceat(good, at), part_counts)
            y = np.where(truth == 1, 1.0, ((good > 0.5) & (good > worst)).astype(float))
    counts = np.array([len(x) for x, *_ in documents])
    whole = with_neighbours(np.concatenate([x for x, *_ in documents]), counts)
    means = document_means(marginals(whole @ weights, moves, counts), np.concatenate([s for _, s, _ in documents]), counts)
    return Field(weights, moves, fit_curve(means, labels))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _known(labels: DataFrame, label: str, id_col: str, held_in) -> DataFrame:
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    known = known if held_in is None else known.filter(held_in)
    return known.groupBy(id_col).agg(F.min(label).alias("y"))


def class_sizes(labels: DataFrame, label: str, *, id_col: str, held_in=None) -> tuple[int, int]:
    """How many ids are labelled 0 and 1."""
    counted = {r.y: r["count"] for r in _known(labels, label, id_col, held_in).groupBy("y").count().collect()}
    return counted.get(0, 0), counted.get(1, 0)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *, id_col: str, text_col: str, held_in=None) -> DataFrame:
    """``doc_id, y, text`` of labelled rows, ``per_class`` of each label at most, drawn by a hash of the id; written to the shared folder.

    A threshold on the hash, from the classes' sizes, leaves a few more rows than are wanted, so that tasks send no more than these to where the least
    are taken. The drawn ids, ``2 * per_class`` at most, are broadcast. Of rows that repeat an id, the one with the least text hash is taken; a
    document labelled twice has its lower label.
    """
    known = _known(labels, label, id_col, held_in)
    wanted = per_class + 6 * per_class**0.5 + 10
    unit = F.pmod(F.xxhash64(id_col, F.lit("train")), F.lit(1 << 52)) / float(1 << 52)
    drawn = []
    for y, size in enumerate(class_sizes(labels, label, id_col=id_col, held_in=held_in)):
        drawn.append(known.filter((F.col("y") == y) & (unit <= min(1.0, wanted / max(size, 1)))).orderBy(unit, id_col).limit(per_class))
    drawn = drawn[0].unionAll(drawn[1]).select(F.col(id_col).alias("doc_id"), "y")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    least = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return cut(least.select("doc_id", "y", "t.text"))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Field | None:
    """The field fitted on a bounded sample of labelled rows that aren't held out. Line features alone go to the driver."""

    def features(rows: pa.RecordBatch) -> dict:
        x, size, counts = line_features(rows.column("text").to_pylist())
        cuts = np.cumsum(counts)[:-1]
        return {"doc_id": rows.column("doc_id"), "y": rows.column("y"), "x": [a.tobytes() for a in np.split(x, cuts)], "size": [a.tobytes() for a in np.split(size, cuts)]}

    kind = dict(docs.dtypes)[id_col]
    sample = training_rows(docs, labels, "quality", per_class, id_col=id_col, text_col=text_col, held_in=~held_out(id_col))
    rows = map_texts(sample, features, f"doc_id {kind}, y int, x binary, size binary", "text").collect()
    rows.sort(key=lambda r: (str(r.doc_id), r.x))
    return train([(np.frombuffer(r.x, np.float32).reshape(-1, OWN), np.frombuffer(r.size, np.int64), r.y) for r in rows])


def score_texts(field: Field | None, texts: list[str]) -> np.ndarray:
    if field is None or not texts:
        return np.full(len(texts), 0.5)
    x, size, counts = line_features(texts)
    good = marginals(with_neighbours(x, counts) @ field.weights, field.moves, counts)
    return 1 / (1 + np.exp(-(field.curve[0] * (document_means(good, size, counts) - 0.5) + field.curve[1])))


def _scored(rows: DataFrame, field: Field | None, text: str) -> DataFrame:
    """``rows``, whose names don't clash, and their ``quality_score``."""

    def scored(part: pa.RecordBatch) -> dict:
        made = score_texts(field, [t or "" for t in part.column(text).to_pylist()])
        return {name: part.column(name) for name in part.schema.names} | {"quality_score": made}

    return map_texts(rows, scored, ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes) + ", quality_score double", text)


def score(docs: DataFrame, field: Field | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, whatever other columns there are.

    A null text counts as empty, and an empty one is a single empty line; without labels of both kinds every score is 0.5.
    Repeated rows stay repeated with equal scores; an empty table gives no rows.
    """
    out = _scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), field, "text")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, field: Field | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``THRESHOLD`` or more, with all their columns."""
    out = _scored(hidden(docs), field, f"kept_{docs.columns.index(text_col)}")
    return out.filter(F.col("quality_score") >= THRESHOLD).drop("quality_score").toDF(*docs.columns)
