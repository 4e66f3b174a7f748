"""Near-duplicates by ProbMinHash.

A text's shingles of five words are weighted by 1 + ln(count). Each shingle sends arrivals, a Poisson process with its weight for
rate, to registers drawn by hash; a register keeps the shingle that arrives first. Two texts then agree in a register with the
probability Jaccard similarity of their weighted shingles. Arrivals later than the last register's first one can't matter, so the
processes end early.

Six registers form a band, and two neighbouring bands a longer one. Texts that agree in a band are candidates: each is
compared with the bucket's head, not with every other. The head is the member that meets most others in all its buckets, the
least id of equals: an original before its altered copies. Candidates are verified on their whole weighted shingle sets; links
make connected components. Where members of a bucket are still in different components, those that aren't in the head's get a
head of their own, round after round, until a round finds no link. Then all members of a bucket that are still in different
components are compared, so no bucket ends with a pair untried: heads only save comparisons. These comparisons make no row for a
pair. A bucket's members meet in blocks, by a byte of each register; those that agree in so many registers as similar texts do, but
for a chance of ``DEVIATIONS`` standard deviations, are looked up in tiles of a component's texts, by a bound on their similarity
that needs sums over shared shingles alone and is exact where no shingle is repeated; what reaches the bound is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import cut, map_texts

WORDS = 5
SIMILARITY = 0.8
#: A link of similarity 0.8 shares a short band with a chance of 0.99994: 1 - (1 - 0.8 ** 6) ** 32.
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Members of a component that a left-over is compared with in one place, members of a bucket that are held at once while all go by, and left-overs in one place.
TILE, PAIRED, ASKED = 64, 512, 1024
#: By how many standard deviations the registers of a similar pair may agree less than on average.
DEVIATIONS = 5.0
#: Words whose hashes a worker keeps.
CACHE = 400_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_words: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that leaves no visible order (the finalizer of splitmix64, whose constants are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weighted_shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the text's shingles, ascending, and their weights. A text of fewer words has one shingle, an empty one none."""
    import xxhash

    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    for w in {*words}.difference(_words):
        if len(_words) >= CACHE:
            _words.clear()
            break
        _words[w] = xxhash.xxh64_intdigest(w)
    get = _words.get
    h = np.fromiter((get(w) or xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    mixed = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(words))):
        mixed = mixed * np.uint64(0x100000001B3) + h[j : j + n]
    found, counts = np.unique(_mix(mixed), return_counts=True)
    return found, 1 + np.log(counts)


def signature(shingles: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The first shingle to arrive at each register; all zeros for no shingles.

    A horizon is set by which all registers will probably have been reached, processes are followed up to it in blocks of arrivals,
    and if a register is still empty the horizon is doubled.
    """
    out = np.zeros(registers, np.uint64)
    if not len(shingles):
        return out
    horizon = registers / weights.sum() * (np.log(registers) + 3)
    while True:
        block = int(horizon * weights.mean() * 1.2) + 2
        active, now, k = np.arange(len(shingles)), np.zeros(len(shingles)), 0
        times, places, owners = [], [], []
        while len(active):
            step = np.arange(k + 1, k + block + 1, dtype=np.uint64)[:, None] * _GOLDEN
            h = _mix(shingles[active] + step)
            t = np.cumsum(-np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[active], axis=0) + now
            inside = np.nonzero(t < horizon)
            times.append(t[inside])
            places.append(h[inside])
            owners.append(active[inside[1]])
            on = t[-1] < horizon
            active, now, k = active[on], t[-1][on], k + block
        time, place = np.concatenate(times), ((np.concatenate(places) & np.uint64(0x7FF)) * np.uint64(registers) >> np.uint64(11)).astype(np.int64)
        order = np.argsort(-time, kind="stable")
        reached = np.zeros(registers, bool)
        reached[place] = True
        if reached.all():
            out[place[order]] = shingles[np.concatenate(owners)[order]]
            return out
        horizon *= 2


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The chance that two weighted sets agree in a register; 1 for two empty ones."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return float(len(ka) == len(kb))
    keys = np.union1d(ka, kb)
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, ka)], y[np.searchsorted(keys, kb)] = wa, wb
    both = (x > 0) & (y > 0)
    ratios, which = np.unique(x[both] / y[both], return_inverse=True)
    mass = np.bincount(which, x[both], minlength=len(ratios))
    return float(sum(m / np.maximum(x, r * y).sum() for r, m in zip(ratios, mass, strict=True)))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A hash for each band, then for each band together with the next. The first are even, the others odd."""
    short = np.zeros(BANDS, np.uint64)
    for j in range(ROWS):
        short = _mix(short * np.uint64(0x100000001B3) + sig.reshape(BANDS, ROWS)[:, j])
    short = _mix(short + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN)
    wide = _mix(short * np.uint64(0x100000001B3) + np.roll(short, -1))
    return np.concatenate([short & ~np.uint64(1), wide | np.uint64(1)]).view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every id in the edges ``a, b``: the least id of its connected component.

    Rounds of taking the neighbours' least label and then that label's own, each written to the shared folder.
    """
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.id == near.a, "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        upper = lower.select(F.col("id").alias("at"), F.col("component").alias("above"))
        new = cut(lower.join(upper, lower.component == upper["at"], "left").select("id", "old", F.least("component", F.coalesce("above", "component")).alias("component")))
        labels = new.select("id", "component")
        if new.filter("old <> component").isEmpty():
            return labels


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``id, head`` whose texts, by ``id`` in ``texts``, are similar enough, as edges ``a, b``."""
    first = pairs.join(texts, "id").select("id", "head", F.col("text").alias("text_a"))
    joined = first.join(texts.select(F.col("id").alias("head"), F.col("text").alias("text_b")), "head").select("id", "head", "text_a", "text_b")

    def compared(rows: pa.RecordBatch) -> dict:
        kept: dict[str, list] = {"a": [], "b": []}
        last: dict[str, tuple] = {}
        for a, b, x, y in zip(*(rows.column(c).to_pylist() for c in ("id", "head", "text_a", "text_b")), strict=True):
            if y not in last:
                last = {y: weighted_shingles(y)}
            if probability_jaccard(weighted_shingles(x), last[y]) >= similarity:
                kept["a"].append(a)
                kept["b"].append(b)
        return kept

    return map_texts(joined, compared, "a bigint, b bigint", "text_a")


def agreement_needed(similarity: float) -> int:
    """The least number of agreeing registers of a pair that is looked up."""
    return int(np.ceil(REGISTERS * similarity - DEVIATIONS * (REGISTERS * similarity * (1 - similarity)) ** 0.5))


def _lot() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(1 << 31))


def asked_apart(members: DataFrame, labels: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Which members of which components each id has to be compared with: ``others, block, id, partners``.

    Of two ids in ``members`` (``band, id``) that share a short band, differ in component and agree in enough registers (``sketches``, ``id,
    sketch``), the one in the larger component, ``others``, is a partner of the other one. ``block`` is the tile of the component. Wide bands add nothing.
    """
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    named = members.filter("band % 2 = 0").join(labels.join(sizes, "component"), "id").select("band", "id", "component", "size")
    mixed = named.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    rows = cut(named.join(mixed, "band").join(sketches, "id").select("band", "id", "component", "size", "sketch", F.ceil(F.col("n") / PAIRED).cast("int").alias("parts")))
    place = ["band", "part", "passing"]
    rows = rows.withColumn("lot", _lot())
    held = rows.withColumn("part", F.pmod(F.hash("id"), "parts")).withColumn("passing", F.lit(False))
    passing = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("passing", F.lit(True))
    columns = [*place, "id", "component", "size", "sketch", "lot"]
    dealt = held.select(*columns).unionAll(passing.select(*columns)).repartition("band", "part").sortWithinPartitions(*place)
    needed, tile = agreement_needed(similarity), TILE
    here: dict = {"at": None}

    def met(batches):
        for batch in batches:
            bands, parts, passes, ids, comps, sizes_, lots = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "part", "passing", "id", "component", "size", "lot"))
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, REGISTERS)
            starts = np.flatnonzero(np.r_[True, (np.diff(bands) != 0) | (np.diff(parts) != 0) | (passes[1:] != passes[:-1])]) if len(ids) else np.zeros(0, int)
            out: dict[tuple, list] = {}
            for a, b in zip(starts, np.r_[starts[1:], len(ids)], strict=True):
                if here["at"] != (bands[a], parts[a]):
                    here.update(at=(bands[a], parts[a]), ids=[], comps=[], sizes=[], sketch=[])
                if not passes[a]:
                    for name, values in (("ids", ids), ("comps", comps), ("sizes", sizes_), ("sketch", sketch)):
                        here[name].append(values[a:b])
                    continue
                if not here["ids"]:  # no member's hash fell into this part
                    continue
                mine, comp, size, marks = (np.concatenate(here[name]) for name in ("ids", "comps", "sizes", "sketch"))
                for c in range(a, b, 64):
                    d = min(b, c + 64)
                    smaller = (size[:, None] < sizes_[None, c:d]) | (size[:, None] == sizes_[None, c:d]) & (comp[:, None] < comps[None, c:d])
                    q, o = np.nonzero(smaller & (comp[:, None] != comps[None, c:d]))
                    alike = (marks[q] == sketch[c + o]).sum(axis=1) >= needed
                    for i, j in zip(q[alike].tolist(), (c + o[alike]).tolist(), strict=True):
                        key = (int(comps[j]), int(lots[j]) % -(-int(sizes_[j]) // tile), int(mine[i]))
                        out.setdefault(key, []).append(int(ids[j]))
            keys = list(out)
            yield pa.RecordBatch.from_pydict({"others": pa.array([k[0] for k in keys], pa.int64()), "block": pa.array([k[1] for k in keys], pa.int32()), "id": pa.array([k[2] for k in keys], pa.int64()), "partners": pa.array([out[k] for k in keys], pa.list_(pa.int64()))})

    found = dealt.mapInArrow(met, "others bigint, block int, id bigint, partners array<bigint>")
    return cut(found.groupBy("others", "block", "id").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners")))


class Tile:
    """Weighted shingle sets that others are compared with."""

    def __init__(self) -> None:
        self.ids, self.sets, self.index = [], [], None

    def add(self, i: int, weighted: tuple[np.ndarray, np.ndarray]) -> None:
        self.ids.append(i)
        self.sets.append(weighted)
        self.index = None

    def bounds(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each set the most that its probability Jaccard similarity with the given one can be.

        Of the sum over all shingles in the definition's denominator, the part over shared ones is replaced by the larger of the two sums of ratios.
        """
        if self.index is None:
            keys = np.concatenate([k for k, _ in self.sets])
            order = np.argsort(keys, kind="stable")
            self.index = keys[order], np.concatenate([w for _, w in self.sets])[order], np.repeat(np.arange(len(self.sets)), [len(k) for k, _ in self.sets])[order], np.array([w.sum() for _, w in self.sets])
        keys, theirs, owner, totals = self.index
        low, high = np.searchsorted(keys, shingles, "left"), np.searchsorted(keys, shingles, "right")
        many = high - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        x, y, whose = np.repeat(weights, many), theirs[at], owner[at]
        x_shared, y_shared = (np.bincount(whose, v, minlength=len(self.sets)) for v in (x, y))
        below = (weights.sum() - x_shared)[whose] / x + (totals - y_shared)[whose] / y + np.maximum(x_shared[whose] / x, y_shared[whose] / y)
        return np.bincount(whose, 1 / below, minlength=len(self.sets))


def verified_apart(asked: DataFrame, labels: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Edges ``a, b`` that join what the similar pairs of ``asked_apart`` join.

    A text goes to each tile of a component that it has partners in, not to each partner; one link to a tile is enough, as its members are joined.
    """
    tile = ["others", "block", "salt"]
    salts = asked.groupBy("others", "block").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("salts"))
    asked = asked.join(salts, ["others", "block"]).select("others", "block", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), "id", "partners")
    sized = labels.join(labels.groupBy("component").agg(F.count("*").alias("size")), "component")
    sized = sized.select(F.col("component").alias("others"), (_lot() % F.ceil(F.col("size") / TILE)).cast("int").alias("block"), "id")
    held = sized.join(asked.select(*tile).distinct(), ["others", "block"]).select(*tile, "id", F.lit(None).cast("array<bigint>").alias("partners"))
    rows = held.unionAll(asked.select(*tile, "id", "partners")).join(texts, "id")
    rows = rows.withColumn("asks", F.col("partners").isNotNull()).repartition(*tile).sortWithinPartitions(*tile, "asks").select(*tile, "id", "partners", "text")
    here: dict = {"at": None, "tile": Tile()}

    def compared(rows: pa.RecordBatch) -> dict:
        kept: dict[str, list] = {"a": [], "b": []}
        for *at, i, partners, text in zip(*(rows.column(c).to_pylist() for c in (*tile, "id", "partners", "text")), strict=True):
            if at != here["at"]:
                here.update(at=at, tile=Tile())
            known, mine = here["tile"], weighted_shingles(text)
            if partners is None:
                known.add(i, mine)
                continue
            wanted = set(partners)
            near = np.flatnonzero(known.bounds(*mine) >= similarity - 1e-9).tolist()
            link = next((known.ids[n] for n in near if known.ids[n] in wanted and probability_jaccard(mine, known.sets[n]) >= similarity), None)
            if link is not None:
                kept["a"].append(i)
                kept["b"].append(link)
        return kept

    return map_texts(rows, compared, "a bigint, b bigint", "text")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id`` for every row: the least id of the documents that a chain of links of ``similarity`` or equality joins.

    Ids are longs. A null text counts as empty; empty texts, or those of white space alone, are alike by equality only. Rows that
    share an id count as one document. A row with a null id takes the class of its equals, or null. An empty table gives no rows; other columns of
    ``df`` are left out. Equal texts are joined by hash before anything else, so a large group of copies costs a row each.
    """
    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def banded(rows: pa.RecordBatch) -> dict:
        out, sketches = [], []
        for text in rows.column("text").to_pylist():
            shingles = weighted_shingles(text)
            registers = signature(*shingles)
            out.append(band_keys(registers) if len(shingles[0]) else [])
            sketches.append(_mix(registers).astype(np.uint8).tobytes())
        return {"id": rows.column("id"), "same": rows.column("same"), "bands": out, "sketch": sketches}

    whole = source.select("id", "text", F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("same"))
    keyed = cut(map_texts(whole, banded, "id bigint, same binary, bands array<bigint>, sketch binary", "text"))
    copies = cut(keyed.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("same", "rep"))
    members = cut(keyed.join(copies, "same", "left").select("id", F.coalesce("rep", "id").alias("rep"), *(F.when(F.col("id") == F.coalesce("rep", "id"), F.col(c)).alias(c) for c in ("bands", "sketch"))))
    rows = members.select("id", F.explode("bands").alias("band")).filter(F.col("id").isNotNull())
    shared = cut(rows.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("met")).filter("low <> high").select("band", "met"))
    active = cut(rows.join(shared, "band").select("band", "id", "met"))
    fame = active.groupBy("id").agg((-F.sum("met")).alias("order"))
    active = cut(active.join(fame, "id").select("band", "id", "order"))
    if active.isEmpty():
        return members.select(F.col("id").alias("doc_id"), F.col("rep").alias("class_id"))
    labels = cut(active.select("id", F.col("id").alias("component")).distinct())
    texts = cut(source.filter(F.col("id").isNotNull()).join(labels.select("id"), "id").select("id", "text"))
    # Rows that share an id have one sketch each, which all take part.
    sketches = members.filter(F.col("sketch").isNotNull() & F.col("id").isNotNull()).join(labels.select("id"), "id").select("id", "sketch").distinct()
    everyone = active.select("band", "id")
    own = lambda c, name: labels.select(F.col("id").alias(c), F.col("component").alias(name))

    def joined(links: DataFrame) -> DataFrame:
        merged = components(links.join(own("a", "x"), "a").join(own("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
        moved = merged.select(F.col("id").alias("component"), F.col("component").alias("to"))
        return cut(labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")))

    while True:
        heads = cut(active.groupBy("band").agg(F.min(F.struct("order", "id")).alias("h")).select("band", F.col("h.id").alias("head")))
        led = active.join(heads, "band").join(own("id", "own"), "id").join(own("head", "heads"), "head").filter("own <> heads")
        led = cut(led.select("band", "id", "order", "head", "own", "heads"))
        links = cut(verified(led.select("id", "head").distinct(), texts, similarity))
        if links.isEmpty():
            break
        labels = joined(links)
        apart = led.select("band", "id", "order", "head").join(own("id", "own"), "id").join(own("head", "heads"), "head").filter("own <> heads")
        active = cut(apart.select("band", "id", "order"))
    links = cut(verified_apart(asked_apart(everyone, labels, sketches, similarity), labels, texts, similarity))
    if not links.isEmpty():
        labels = joined(links)
    found = labels.select(F.col("id").alias("rep"), "component")
    return members.join(found, "rep", "left").select(F.col("id").alias("doc_id"), F.coalesce("component", "rep").alias("class_id"))
