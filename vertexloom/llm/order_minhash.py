"""Document fingerprints by Order MinHash, with DataFrame functions only.

A text's tokens are its words, or the single characters of runs without white space that are longer than ``LONGEST_WORD``, so that
an edit inside such a run changes what is near it alone. Three tokens in a row form a k-mer. A k-mer and the number of its earlier
occurrences in the text make one element, with a hash and a place. For each of ``SKETCHES`` orders of the elements the two least
ones are taken, put back into the order of the text, and hashed as a pair: texts agree there when they share these elements and
their order, which a change of arrangement destroys as it does not for plain MinHash.

The orders come from ``CIRCLES`` independent hashes of the elements. Each hash puts the elements on a circle, and each of its
orders starts at one of evenly spaced points: one sort serves all orders of a circle. Orders of one circle are independent where
a text has a few elements for each point; a text of n elements has n different sketches in each circle at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.common import cut

SKETCHES, CIRCLES = 64, 4
POINTS = SKETCHES // CIRCLES
WORDS = 3
LONGEST_WORD = 16
TOKEN = rf"(?<!\S)\S{{1,{LONGEST_WORD}}}(?!\S)|\S"
#: An element is a long: its hash above, its place in the text in the low bits, which hold any place that an array has.
PLACE_BITS = 31
_PLACES = (1 << PLACE_BITS) - 1
_HASHES = -(1 << PLACE_BITS)
#: Rows without an id are spread over so many keys.
SPREAD = 4096


def _hash_of(e: Column) -> Column:
    return e.bitwiseAND(F.lit(_HASHES))


def _place_of(e: Column) -> Column:
    return e.bitwiseAND(F.lit(_PLACES))


def elements(words: Column) -> Column:
    """Step 1: the k-mers of hashed words as longs, sorted by hash and place. A text of fewer words has one k-mer."""
    last = F.greatest(F.size(words) - WORDS, F.lit(0))
    return F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: _hash_of(F.xxhash64(*(F.get(words, i + j) for j in range(WORDS)))).bitwiseOR(i.cast("long"))))


def first_places(sorted_: Column) -> Column:
    """Step 2: where each distinct k-mer begins among the sorted elements."""
    at = lambda i: F.get(sorted_, i)
    return F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: (i == 0) | (_hash_of(at(i)) != _hash_of(at(i - 1))))


def numbered(sorted_: Column, firsts: Column) -> Column:
    """Step 3: repeated k-mers get hashes of their own by the number of occurrences before; sorted again."""
    n = F.size(sorted_)
    at = lambda i: F.get(sorted_, i)

    def group(first: Column, g: Column) -> Column:
        end = F.coalesce(F.get(firsts, g + 1), n) - 1
        return F.transform(F.sequence(first, end), lambda i: F.coalesce(F.when(i == first, at(i)).otherwise(_hash_of(F.xxhash64(_hash_of(at(i)), i - first)).bitwiseOR(_place_of(at(i)))), F.lit(0)))

    return F.when(F.size(firsts) == n, sorted_).otherwise(F.sort_array(F.flatten(F.transform(firsts, group))))


def rehashed(elements_: Column, circle: int) -> Column:
    """Step 4: the elements by another hash, sorted by it; the first circle has them as they are."""
    return F.sort_array(F.transform(elements_, lambda e: _hash_of(F.xxhash64(_hash_of(e), F.lit(circle))).bitwiseOR(_place_of(e)))) if circle else elements_


def halvings(sorted_: Column) -> Column:
    """The powers of two up to the number of elements, falling: the steps of a binary search."""
    return F.filter(F.array(*(F.lit(1 << b) for b in reversed(range(31)))), lambda step: step <= F.size(sorted_))


def marks_of(sorted_: Column, steps: Column) -> Column:
    """Step 5: for each starting point of the circle the number of elements before it."""
    points = F.array(*(F.lit((j << 64) // POINTS - (1 << 63)).cast("long") for j in range(POINTS)))
    further = lambda point: lambda at, step: F.when((at + step <= F.size(sorted_)) & (F.get(sorted_, at + step - 1) < point), at + step).otherwise(at)
    return F.transform(points, lambda point: F.aggregate(steps, F.lit(0), further(point)))


def sketches(sorted_: Column, marks: Column) -> Column:
    """Step 6: for each starting point the hash of the two elements that follow it on the circle, in text order."""
    n = F.size(sorted_)

    def pair(mark: Column) -> Column:
        a, b = F.get(sorted_, mark % n), F.get(sorted_, (mark + 1) % n)
        swap = _place_of(a) > _place_of(b)
        low, high = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
        return F.xxhash64(_hash_of(low), _hash_of(high)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    return F.transform(marks, pair)


def add_signature(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the array column ``name``: the text's signature of ``SKETCHES`` integers below 2**31. A null text counts as empty; an empty one has a signature too.

    Every step is a column of its own, for what a lambda refers to is computed anew for each entry unless it is a column.
    """
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))
    kept = df.columns
    df = df.withColumn("omh_words", words).withColumn("omh_sorted", elements(F.col("omh_words")))
    df = df.withColumn("omh_firsts", first_places(F.col("omh_sorted")))
    df = df.withColumn("omh_all", numbered(F.col("omh_sorted"), F.col("omh_firsts")))
    df = df.withColumns({f"omh_circle_{c}": rehashed(F.col("omh_all"), c) for c in range(CIRCLES)}).withColumn("omh_steps", halvings(F.col("omh_all")))
    df = df.withColumns({f"omh_marks_{c}": marks_of(F.col(f"omh_circle_{c}"), F.col("omh_steps")) for c in range(CIRCLES)})
    return df.select(*kept, F.concat(*(sketches(F.col(f"omh_circle_{c}"), F.col(f"omh_marks_{c}")) for c in range(CIRCLES))).alias(name))


def written(signature: Column) -> Column:
    """The signature as a string, eight hex digits for each sketch."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of sketches in which two signatures agree."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same.cast("double") / SKETCHES


def following(ids: DataFrame) -> DataFrame:
    """``id, next_id`` for the distinct longs in ``ids.id``: the least greater one, null for the greatest.

    Ids are dealt by ranges of a sample, whatever gaps they have, and windows are within a range; a last window has one row for each range.
    """
    ranges = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(ids.select("id").repartitionByRange(ranges, "id").withColumn("range", F.spark_partition_id()))
    inside = ranged.withColumn("inner_next", F.lead("id").over(Window.partitionBy("range").orderBy("id")))
    starts = ranged.groupBy("range").agg(F.min("id").alias("least"))
    starts = starts.select("range", F.lead("least").over(Window.orderBy("range")).alias("after"))  # a row for each range
    return inside.join(F.broadcast(starts), "range").select("id", F.coalesce("inner_next", "after").alias("next_id"))


def edited_pairs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its edited text and the two signatures that it is compared with.

    Gives ``doc_id, n_chars, text, edited, signature, next_signature``: edited is the text with the last half of its code points, rounded
    down, replaced by as many (or all) from the start of the next document, by ascending id, after the last the first. Where rows
    share an id, the one whose text has the least hash stands for that id as the next document. A null text counts as empty. A
    null id follows nothing and is next to nothing: its row is edited with an empty text and compared with an empty one. Rows that share an id
    share a key of the joins, which adaptive execution splits where they are many.
    Whole texts are shuffled once, and the parts of them that edit others once.
    """
    # A key for every row, so that both joins below read one exchange: neither filters nulls, and rows without an id don't share a key.
    key = F.coalesce(F.col(id_col).cast("long").cast("string"), F.concat(F.lit("n"), F.pmod(F.xxhash64(F.col(text_col)), F.lit(SPREAD)).cast("string")), F.lit("n"))
    whole = df.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = add_signature(whole, F.col("text"), "signature")
    ids = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.floor(F.char_length(F.coalesce(F.col(text_col), F.lit(""))) / 2).alias("half"))
    ids = cut(ids.groupBy("id").agg(F.max("half").alias("half")))
    least = ids.agg(F.min("id").alias("least")).first().least
    ring = following(ids).join(ids, "id").select(F.coalesce("next_id", F.lit(least).cast("long")).cast("string").alias("at"), F.col("id").cast("string").alias("for_id"), "half")
    parts = docs.join(ring.hint("merge"), F.col("key") == F.col("at")).select("for_id", F.struct(F.xxhash64("text").alias("h"), F.expr("substring(text, 1, int(half))").alias("part"), F.col("signature").alias("next_signature")).alias("p"))
    parts = parts.groupBy("for_id").agg(F.min("p").alias("p"))
    empty = add_signature(df.sparkSession.range(1), F.lit(""), "s").first()["s"]
    joined = docs.join(parts.hint("merge"), F.col("key") == F.col("for_id"), "left").withColumn("n_chars", F.char_length("text").cast("long"))
    kept = F.expr("substring(text, 1, int(n_chars - floor(n_chars / 2)))")
    taken = F.expr("substring(p.part, 1, int(floor(n_chars / 2)))")
    return joined.select(F.expr("try_cast(key AS bigint)").alias("doc_id"), "n_chars", "text", F.concat(kept, F.coalesce(taken, F.lit(""))).alias("edited"), "signature", F.coalesce(F.col("p.next_signature"), F.array(*map(F.lit, empty))).alias("next_signature"))
