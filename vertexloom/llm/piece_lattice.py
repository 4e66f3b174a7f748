"""SentencePiece encoding to the N best segmentations, and decoding.

The lattice of a text has an edge for every vocabulary piece that matches at a place, scored as the model scores the piece, and,
where no piece is a character, an edge of its UTF-8 bytes. Forward Viterbi scores are the exact cost of what is left when one
searches from the end backwards, so an A* search with them for heuristic takes segmentations off its queue best first.

Where no piece crosses from a word into the space before the next one, lattices of words are independent: the forward pass over
each distinct word also gives its loss by its second best segmentation, and the N best of a text differ from its best in the
N - 1 words with the least loss at most, which alone are searched by A*. With a model whose pieces cross words, a text is one word.
The forward pass steps through all new words of one length together, and through a long word alone, with equal results.
"""

from __future__ import annotations

import functools
import heapq
import operator
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import map_texts

SPACE = "▁"
NBEST = 4
#: Words of up to so many characters are segmented together, so many at once; longer ones one by one.
BATCH_LENGTH = 24
BATCH_WORDS = 8192
#: Words, and characters of words, that a worker keeps segmented, and bytes of text that it segments at once.
KEPT_WORDS, KEPT_CHARS = 400_000, 8_000_000
SLICE_BYTES = 6 << 20
UNKNOWN_PENALTY = 10.0
_INFINITE = float("inf")
_PRIME, _MIX, _SHIFT = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(44)

#: An edge into a place: its length, score, and the piece's id, or -1 for a character that is spelled by its bytes.
Edge = tuple[int, float, int]


class Vocabulary:
    """Pieces and scores of a model file. unknown: score of a character without a piece, which becomes its bytes."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.score = {names[i]: model.get_score(i) for i in ids}
        self.id = {names[i]: i for i in ids}
        self.bytes = {int(names[i][3:-1], 16): i for i in range(len(names)) if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        self.longest = max(map(len, self.id))
        self.unknown = min((s for s in self.score.values() if s > -1e8), default=0.0) - UNKNOWN_PENALTY
        back_bytes = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [back_bytes.get(i) or name.encode() for i, name in enumerate(names)]
        self.lines = any("\n" in p for p in self.id)
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.single = frozenset(p for p in self.id if len(p) == 1)
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.matcher.add_word(piece, (len(piece), self.score[piece], i))
        self.matcher.make_automaton()
        keys = np.array([self._key(p) for p in self.id], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        order = np.argsort(keys)
        self.keys, self.key_scores, self.key_ids = keys[order], np.array(list(self.score.values()))[order], np.array(ids)[order].astype(np.int32)
        self.maybe = np.zeros(1 << (64 - int(_SHIFT)), bool)  # rules out most strings that aren't pieces
        self.maybe[(keys * _MIX) >> _SHIFT] = True
        self.raw_length = np.array([len(r) for r in self.raw], np.int64)
        self.raw_begin = np.cumsum(self.raw_length) - self.raw_length
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.known = KnownWords(self)

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_PRIME) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def spell(self, character: str) -> list[int]:
        return [self.bytes.get(b, self.unknown_id) for b in character.encode()]

    def spelled(self, word: str, by_end) -> list[int]:
        """The ids by the places where their pieces end, -1 there for a character that is spelled by its bytes, less for no piece."""
        out: list[int] = []
        for end, i in enumerate(by_end):
            if i >= 0:
                out.append(int(i))
            elif i == -1:
                out += self.spell(word[end - 1])
        return out

    def ids_of(self, piece: str) -> list[int]:
        found = self.id.get(piece)
        return self.spell(piece) if found is None else [found]


def lattice(v: Vocabulary, word: str) -> list[list[Edge]]:
    """The edges into each place of the word, longest first."""
    into: list[list[Edge]] = [[] for _ in range(len(word) + 1)]
    for last, edge in v.matcher.iter(word):
        into[last + 1].append(edge)
    if not v.single.issuperset(word):
        for at, c in enumerate(word, 1):
            if c not in v.single:
                into[at].append((1, v.unknown, -1))
    return into


def forward(into: list[list[Edge]]) -> tuple[list[float], list[float], list[Edge | None]]:
    """Best and second best score up to each place, and the last edge of the best; the longest piece wins a tie."""
    places = len(into)
    best, second, back = [0.0] + [-_INFINITE] * (places - 1), [-_INFINITE] * places, [None] * places
    for end, edges in enumerate(into):
        for edge in edges:
            start, score = end - edge[0], edge[1]
            total, other = best[start] + score, best[end]
            if total > other:
                after = second[start] + score
                second[end] = other if other > after else after
                best[end], back[end] = total, edge
            elif total > second[end]:
                second[end] = total
    return best, second, back


def forward_batch(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``forward`` for words of one length: best scores, losses by the second best, numbers of the best one's ids, where these begin, and all ids in one array."""
    n, count = len(words[0]), len(words)
    points = np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(count, n).T).astype(np.uint64) + np.uint64(1)
    best, second = np.full((n + 1, count), -np.inf), np.full((n + 1, count), -np.inf)
    best[0] = 0
    back, piece = np.zeros((n + 1, count), np.int64), np.full((n + 1, count), -1, np.int32)
    hashes = np.zeros((n, count), np.uint64)

    def relax(start: int, end: int, rows: np.ndarray, score, ids) -> None:
        total, other = best[start][rows] + score, best[end][rows]
        second[end][rows] = np.maximum(np.maximum(second[end][rows], second[start][rows] + score), np.minimum(total, other))
        better = total > other
        won = rows[better]
        best[end][won], back[end][won], piece[end][won] = total[better], start, ids[better]

    for end in range(1, n + 1):
        low = max(0, end - v.longest)
        here = hashes[low:end]
        here *= _PRIME
        here += points[end - 1]
        starts, rows = np.nonzero(v.maybe[(here * _MIX) >> _SHIFT])
        wanted = here[starts, rows]
        at = np.minimum(np.searchsorted(v.keys, wanted), len(v.keys) - 1)
        known = v.keys[at] == wanted
        starts, rows, at = starts[known], rows[known], at[known]
        scores, ids, bounds = v.key_scores[at], v.key_ids[at], np.searchsorted(starts, np.arange(end - low + 1))
        for j in range(end - low):
            a, b = bounds[j], bounds[j + 1]
            if a < b:
                relax(low + j, end, rows[a:b], scores[a:b], ids[a:b])
        if b - a < count:
            unknown = np.ones(count, bool)
            unknown[rows[a:b]] = False
            unknown = np.flatnonzero(unknown)
            relax(end - 1, end, unknown, v.unknown, np.full(len(unknown), -1, np.int32))
    place, rows = np.full(count, n), np.arange(count)
    id_of = np.full((n + 1, count), -2, np.int32)
    while len(rows):
        end = place[rows]
        id_of[end, rows] = piece[end, rows]
        place[rows] = back[end, rows]
        rows = rows[place[rows] > 0]
    odd = (id_of == -1).any(axis=0)
    taken = ((id_of >= 0) & ~odd).T
    lengths, flat = taken.sum(axis=1), [id_of.T[taken]]
    begin = np.cumsum(lengths) - lengths
    total = len(flat[0])
    for i in np.flatnonzero(odd).tolist():
        flat.append(np.array(v.spelled(words[i], id_of[:, i].tolist()), np.int32))
        lengths[i], begin[i] = len(flat[-1]), total
        total += len(flat[-1])
    return best[n], best[n] - second[n], lengths, begin, np.concatenate(flat)


class KnownWords(dict):
    """Rows of words met before: score, loss by the second best, and the best ids in one flat array. A new word gets a row when it is asked for, and the rest by ``segment``."""

    def __init__(self, v: Vocabulary) -> None:
        super().__init__()
        self.v, self.words, self.chars, self.done = v, [], 0, 0
        self.score, self.loss, self.lengths, self.begin, self.flat = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.searched: dict[int, list] = {}

    def forget(self) -> None:
        """Forgets all words if there are too many. Row numbers taken before are void after it."""
        if len(self.words) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.clear()
            self.__init__(self.v)

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self.words)
        self.words.append(word)
        return row

    def segment(self) -> None:
        """Segments the words that have no more than a row."""
        new = self.words[self.done :]
        if not new:
            return
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        score, loss, lengths, begin = np.zeros(len(new)), np.zeros(len(new)), np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        flat, total = [self.flat], len(self.flat)
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            step = BATCH_WORDS if size <= BATCH_LENGTH else 1
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                score[part], loss[part], lengths[part], first, ids = (forward_batch if size <= BATCH_LENGTH else self._alone)(self.v, [new[i] for i in part])
                begin[part] = total + first
                flat.append(ids.astype("<u4"))
                total += len(ids)
        self.score, self.loss, self.lengths, self.begin = (np.append(old, x) for old, x in ((self.score, score), (self.loss, loss), (self.lengths, lengths), (self.begin, begin)))
        self.flat = np.concatenate(flat)
        self.done, self.chars = len(self.words), self.chars + int(sizes.sum())

    @staticmethod
    def _alone(v: Vocabulary, words: list[str]) -> tuple[float, float, int, int, np.ndarray]:
        (word,) = words
        best, second, back = forward(lattice(v, word))
        ids, at = [-2] * (len(word) + 1), len(word)
        while at:
            size, _, ids[at] = back[at]
            at -= size
        found = v.spelled(word, ids)
        return best[-1], best[-1] - second[-1], len(found), 0, np.array(found, np.int64)

    def ways(self, row: int, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The word's ``n`` best segmentations, the one whose ids are kept first."""
        if row not in self.searched:
            word = self.words[row]
            found = n_best(self.v, word, n)
            kept = best_cuts(self.v, word)
            self.searched[row] = [(found[0][0], kept), *[w for w in found if w[1] != kept][: n - 1]]
        return self.searched[row]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def normalized(text: str) -> str:
    """The text as pieces spell it: a space in front, spaces written as a visible mark; an empty text has no pieces."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def best_cuts(v: Vocabulary, word: str) -> tuple[int, ...]:
    *_, back = forward(lattice(v, word))
    cuts, at = [], len(word)
    while at:
        cuts.append(at)
        at -= back[at][0]
    return tuple(reversed(cuts))


def n_best(v: Vocabulary, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best segmentations as (score, cuts), best first; cuts are the places where pieces end.

    Backward A*: a partial path holds the pieces from some place to the end; forward Viterbi scores say exactly what the rest adds.
    A queue entry is one edge more for such a path, which it refers to; the next better edge into the same place is queued when it
    is taken off, so that the queue grows by two entries a step whatever the word's length. Of equals the newest goes on, so that ties don't fan out.
    """
    into = lattice(v, word)
    best, _, _ = forward(into)
    rated: dict[int, list] = {}
    queue: list[tuple] = []
    pushed = 0

    def push(at: int, rank: int, after: float, path: tuple | None) -> None:
        nonlocal pushed
        if at not in rated:
            rated[at] = sorted((-(best[at - size] + score), at - size, score) for size, score, _ in into[at])
        if rank < len(rated[at]):
            pushed += 1
            heapq.heappush(queue, (rated[at][rank][0] - after, -pushed, at, rank, after, path))

    out = []
    if not word:
        return [(0.0, ())]
    push(len(word), 0, 0.0, None)
    while queue and len(out) < n:
        total, _, at, rank, after, path = heapq.heappop(queue)
        push(at, rank + 1, after, path)
        _, start, score = rated[at][rank]
        longer = (at, path)
        if start:
            push(start, 0, after + score, longer)
            continue
        cuts = []
        while longer:
            cut, longer = longer
            cuts.append(cut)
        out.append((-total, tuple(cuts)))
    return out


def cuts_to_ids(v: Vocabulary, word: str, cuts: tuple[int, ...]) -> list[int]:
    return [i for a, b in zip((0, *cuts), cuts, strict=False) for i in v.ids_of(word[a:b])]


WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n+[^{SPACE}\n]*|[^{SPACE}\n]+")
SPACED_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def words_of(v: Vocabulary, text: str) -> list[str]:
    """The normalized text cut where no piece crosses: before spaces, and before line ends if no piece has one; uncut if pieces cross words."""
    plain = normalized(text)
    if v.crossing:
        return [plain] if plain else []
    return (SPACED_WORD if v.lines else WORD).findall(plain)


def encode_batch(v: Vocabulary, texts: list[str], n: int = NBEST) -> list[list[tuple[float, np.ndarray]]]:
    """For each text its ``n`` best segmentations, or all if there are fewer, as (score, ids), best first."""
    known = v.known
    known.forget()
    words = [words_of(v, t) for t in texts]
    rows = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in words]
    known.segment()
    return [_ways(v, w, r, n) for w, r in zip(words, rows, strict=True)]


def _ways(v: Vocabulary, words: list[str], rows: np.ndarray, n: int) -> list[tuple[float, np.ndarray]]:
    if not words:
        return [(0.0, np.zeros(0, "<u4"))]
    known = v.known
    size, loss = known.lengths[rows], known.loss[rows]
    ends = np.cumsum(size)
    best = known.flat[np.repeat(known.begin[rows] - (ends - size), size) + np.arange(int(ends[-1]))]
    base = float(known.score[rows].sum())
    sums: list[tuple[float, tuple]] = [(0.0, ())]
    for at in np.argsort(loss, kind="stable")[: n - 1].tolist():
        if np.isfinite(loss[at]):
            ways = known.ways(int(rows[at]), n)
            sums = heapq.nsmallest(n, [(lost + max(0.0, ways[0][0] - s), (*changes, (at, k)) if k else changes) for lost, changes in sums for k, (s, _) in enumerate(ways)], key=operator.itemgetter(0))
    made = []
    for lost, changes in sums:
        pieces, last = [], 0
        for at, k in sorted(changes):
            pieces += [best[last : ends[at] - size[at]], np.array(cuts_to_ids(v, words[at], known.ways(int(rows[at]), n)[k][1]), "<u4")]
            last = ends[at]
        made.append((base - lost, np.concatenate([*pieces, best[last:]]) if changes else best))
    return made


def decode(v: Vocabulary, ids) -> str:
    """The text of the ids: bytes put together, marks made spaces, and the space in front taken off."""
    ids = np.asarray(ids, np.int64)
    size = v.raw_length[ids]
    ends = np.cumsum(size)
    places = np.repeat(v.raw_begin[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ids) else 0)
    text = v.raw_flat[places].tobytes().decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def encode(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", n: int = NBEST, with_ids: bool = True) -> DataFrame:
    """A row for each text and each of its ``n`` best segmentations: ``doc_id, rank`` (from 1), ``score, n_pieces, ids_crc32, round_trip`` and, if asked for, ``ids``.

    ``round_trip`` tells whether the ids decode to the text. A null text counts as empty: one segmentation without pieces, score 0. A text with fewer
    segmentations has fewer rows. Equal scores may come in any fixed order. The visible space mark in a text decodes to a space.
    Repeated rows give repeated rows; an empty table gives none; other columns of ``df`` are left out.
    """

    def made(rows: pa.RecordBatch) -> dict:
        v = vocabulary(model_path)
        texts = [t or "" for t in rows.column("text").to_pylist()]
        out: dict[str, list] = {k: [] for k in ("doc_id", "rank", "score", "n_pieces", "ids_crc32", "round_trip", "ids")}
        for doc, text, ways in zip(rows.column("doc_id").to_pylist(), texts, encode_batch(v, texts, n), strict=True):
            for rank, (score, ids) in enumerate(ways, 1):
                values = (doc, rank, score, len(ids), zlib.crc32(ids), decode(v, ids) == text, ids.astype("i4") if with_ids else None)
                for k, value in zip(out, values, strict=True):
                    out[k].append(value)
        return out

    kind = dict(df.dtypes)[id_col]
    return map_texts(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), made, f"doc_id {kind}, rank int, score double, n_pieces bigint, ids_crc32 bigint, round_trip boolean" + ", ids array<int>" * with_ids, "text", SLICE_BYTES)
