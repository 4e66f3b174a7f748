"""Placement and communication of a model and its graph over parts: what each part holds, needs and sends.

Tables: ``ops (op, kind)`` and ``op_edges (producer, consumer)`` of a model, numbered in its order; ``parts (part, vid_begin, vid_end,
op_begin, op_end)``, half-open; ``edges (src, dst)``; ``chunks (chunk, begin, end, fragment)``. Parts, chunks and operators are few
and given by the user, which bounds what is broadcast here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BYTES = 4
MEGABYTE = 1024.0 * 1024.0


def placed_operators(ops: DataFrame, op_edges: DataFrame, parts: int) -> DataFrame:
    """``op, part``: operators with inputs are dealt out evenly in order, the last part taking what is left; others go with their last consumer."""
    layers = op_edges.select(F.col("consumer").alias("op")).distinct()
    n = layers.count()
    if n < parts:
        raise ValueError("fewer operators with inputs than parts")
    dealt = layers.select("op", F.least(F.floor((F.row_number().over(Window.orderBy("op")) - 1) / (n // parts)), F.lit(parts - 1)).cast("long").alias("part"))
    used = op_edges.join(dealt, op_edges.consumer == dealt.op).groupBy(F.col("producer").alias("op")).agg(F.max("part").alias("with"))
    return ops.select("op").join(dealt, "op", "left").join(used, "op", "left").select("op", F.coalesce("part", "with").alias("part"))


def boundary_tensors(op_edges: DataFrame, placed: DataFrame) -> DataFrame:
    """``tensor, from_part, to_part``: outputs that another part consumes."""
    a, b = placed.select(F.col("op").alias("producer"), F.col("part").alias("from_part")), placed.select(F.col("op").alias("consumer"), F.col("part").alias("to_part"))
    joined = op_edges.join(a, "producer").join(b, "consumer").filter("from_part <> to_part")
    return joined.select(F.col("producer").alias("tensor"), "from_part", "to_part").distinct()


def order_faults(op_edges: DataFrame) -> DataFrame:
    """Inputs that aren't produced before they are used."""
    return op_edges.filter("producer >= consumer")


def coverage(ops: DataFrame, parts: DataFrame, vertices: int) -> DataFrame:
    """``op, covered, overlaps, valid``: whether the ranges of the parts that hold an operator cover all vertices once."""
    held = ops.join(F.broadcast(parts), (F.col("op") >= F.col("op_begin")) & (F.col("op") < F.col("op_end")))
    before = F.lag("vid_end").over(Window.partitionBy("op").orderBy("vid_begin", "vid_end"))
    sized = held.withColumn("overlap", F.when(before > F.col("vid_begin"), 1).otherwise(0))
    found = sized.groupBy("op").agg(F.sum(F.col("vid_end") - F.col("vid_begin")).alias("covered"), F.sum("overlap").alias("overlaps"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return ops.select("op").join(found, "op", "left").select("op", zero("covered"), zero("overlaps")).withColumn("valid", (F.col("covered") == vertices) & (F.col("overlaps") == 0))


def fragments(parts: DataFrame) -> DataFrame:
    """``fragment, begin, end``: the intervals between the distinct ends of all ranges."""
    ends = parts.select(F.explode(F.array("vid_begin", "vid_end")).alias("begin")).distinct()
    order = Window.orderBy("begin")
    cut = ends.select((F.row_number().over(order) - 1).cast("long").alias("fragment"), "begin", F.lead("begin").over(order).alias("end"))
    return cut.filter("end is not null")


def owners(parts: DataFrame, cut: DataFrame) -> DataFrame:
    """The rows of ``parts`` with each ``fragment`` of ``cut`` in their ranges. A fragment lies inside a range or outside."""
    return cut.join(F.broadcast(parts), (F.col("begin") >= F.col("vid_begin")) & (F.col("end") <= F.col("vid_end")))


def chunks(parts: DataFrame, size: int) -> DataFrame:
    """``chunk, begin, end, fragment``: fragments cut into pieces of ``size``, the last of each being shorter."""
    pieces = fragments(parts).select("fragment", F.col("end").alias("stop"), F.explode(F.expr(f"sequence(begin, end - 1, {size}L)")).alias("begin"))
    number = F.row_number().over(Window.orderBy("begin")) - 1
    return pieces.select(number.cast("long").alias("chunk"), "begin", F.least(F.col("begin") + size, F.col("stop")).alias("end"), "fragment")


def chunk_of(ids: DataFrame, column: str, chunk_table: DataFrame) -> DataFrame:
    """``ids`` and the ``chunk`` and ``fragment`` that hold ``column``.

    Both sides are cut into buckets of the mean chunk size, so that a row is compared with the few chunks of its bucket.
    """
    known = chunk_table.agg(F.min("begin").alias("low"), F.max("end").alias("high"), F.count("*").alias("n")).first()
    width = max(1, (known.high - known.low) // known.n) if known.n else 1
    bucketed = chunk_table.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("end") - 1) / width))))
    joined = ids.withColumn("_bucket", F.floor(F.col(column) / width)).join(bucketed, "_bucket")
    return joined.filter((F.col(column) >= F.col("begin")) & (F.col(column) < F.col("end"))).drop("_bucket", "begin", "end")


def equal_chunk(v: Column, vertices: int, n: int) -> Column:
    """The chunk of ``v`` when vertices are cut into ``n`` equal ones, the last taking what is left."""
    return F.least(F.floor(v / max(1, vertices // n)), F.lit(n - 1)).cast("long")


def cross_edges(edges: DataFrame, part_of) -> DataFrame:
    """``src, dst, part_src, part_dst`` of edges between parts; ``part_of`` is a function from an id column to its part."""
    return edges.select("src", "dst", part_of(F.col("src")).alias("part_src"), part_of(F.col("dst")).alias("part_dst")).filter("part_src <> part_dst")


def incoming_mirrors(edges: DataFrame, part_of) -> DataFrame:
    """``part, v``: vertices of other parts with an edge into the part."""
    return cross_edges(edges, part_of).select(F.col("part_dst").alias("part"), F.col("src").alias("v")).distinct()


def outgoing_mirrors(edges: DataFrame, part_of) -> DataFrame:
    """``part, v``: vertices of other parts with an edge from the part."""
    return cross_edges(edges, part_of).select(F.col("part_src").alias("part"), F.col("dst").alias("v")).distinct()


def local_ids(vertices: DataFrame, edges: DataFrame, part_of, part: int) -> DataFrame:
    """``v, is_mirror, local``: the part's own vertices, then its incoming mirrors, each in order of id, numbered from 0."""
    from vertexloom.operators.ordered import ranked

    own = vertices.select("v").filter(part_of(F.col("v")) == part)
    mirrors = incoming_mirrors(edges, part_of).filter(F.col("part") == part).select("v")
    first = ranked(own, "v", "local").select("v", F.lit(0).cast("long").alias("is_mirror"), "local")
    second = ranked(mirrors, "v", "local").withColumn("local", F.col("local") + own.count())
    return first.unionByName(second.select("v", F.lit(1).cast("long").alias("is_mirror"), "local"))


def stage_links(ops: DataFrame, op_edges: DataFrame, parts: DataFrame) -> DataFrame:
    """``direction, part, fragment, peer, tensor``: what a part needs from others for each fragment in its own range.

    Forward: outputs that it consumes and another part of that fragment produces. Backward: gradients of its outputs from the parts
    that consume them. Weights aren't counted.
    """
    owner = owners(parts, fragments(parts)).select("fragment", "part", "op_begin", "op_end")
    tensors = op_edges.join(ops.filter("kind <> 'WEIGHT'").select(F.col("op").alias("producer")), "producer")
    a, b = owner.alias("a"), owner.alias("b")
    pairs = a.join(b, (F.col("a.fragment") == F.col("b.fragment")) & (F.col("a.part") != F.col("b.part")))
    used = pairs.join(F.broadcast(tensors), (F.col("producer") >= F.col("b.op_begin")) & (F.col("producer") < F.col("b.op_end")) & (F.col("consumer") >= F.col("a.op_begin")) & (F.col("consumer") < F.col("a.op_end")))
    forward = used.select(F.lit("forward").alias("direction"), F.col("a.part").alias("part"), F.col("a.fragment").alias("fragment"), F.col("b.part").alias("peer"), F.col("producer").alias("tensor"))
    backward = used.select(F.lit("backward").alias("direction"), F.col("b.part").alias("part"), F.col("a.fragment").alias("fragment"), F.col("a.part").alias("peer"), F.col("producer").alias("tensor"))
    return forward.unionByName(backward).distinct()


def range_pairs(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """``part, peer``: an edge leads from the part's range into the peer's; ranges that coincide or overlap count as well.

    Each end finds its fragment once; what is compared with the parts is the distinct pairs of fragments, not the edges.
    """
    cut = fragments(parts)
    ends = chunk_of(edges.select("src", "dst"), "src", cut).select("dst", F.col("fragment").alias("from"))
    ends = chunk_of(ends, "dst", cut).select("from", F.col("fragment").alias("to")).distinct()
    own = owners(parts, cut)
    a, b = own.select(F.col("fragment").alias("from"), "part"), own.select(F.col("fragment").alias("to"), F.col("part").alias("peer"))
    return ends.join(a, "from").join(b, "to").filter("part <> peer").select("part", "peer").distinct()


def graph_links(ops: DataFrame, op_edges: DataFrame, parts: DataFrame, edges: DataFrame) -> DataFrame:
    """``direction, part, peer, tensor``: what a part sends along edges of the graph.

    Activation: its outputs that an aggregation of the peer takes, if an edge leads from its range to the peer's. Gradient: of an
    aggregation's output that both parts hold, if an edge leads from the peer's range to its own.
    """
    pairs = range_pairs(edges, parts)
    held = parts.select("part", "op_begin", "op_end")
    mine, theirs = held.select(F.col("part"), F.col("op_begin").alias("mb"), F.col("op_end").alias("me")), held.select(F.col("part").alias("peer"), F.col("op_begin").alias("pb"), F.col("op_end").alias("pe"))
    gathers = ops.filter("kind = 'AGGREGATION'").select(F.col("op").alias("consumer"))
    inputs = op_edges.join(gathers, "consumer")
    ranged = pairs.join(F.broadcast(mine), "part").join(F.broadcast(theirs), "peer")
    sent = ranged.join(F.broadcast(inputs), (F.col("producer") >= F.col("mb")) & (F.col("producer") < F.col("me")) & (F.col("consumer") >= F.col("pb")) & (F.col("consumer") < F.col("pe")))
    activation = sent.select(F.lit("activation").alias("direction"), "part", "peer", F.col("producer").alias("tensor"))
    back = pairs.select(F.col("peer").alias("part"), F.col("part").alias("peer")).join(F.broadcast(mine), "part").join(F.broadcast(theirs), "peer")
    shared = back.join(F.broadcast(gathers), (F.col("consumer") >= F.greatest("mb", "pb")) & (F.col("consumer") < F.least("me", "pe")))
    gradient = shared.select(F.lit("gradient").alias("direction"), "part", "peer", F.col("consumer").alias("tensor"))
    return activation.unionByName(gradient).distinct()


def updates_to_receive(edges: DataFrame, parts: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """``part, activations, gradients``: for each part the remote chunks that own at least one of its in- or out-neighbours.

    ``chunk_table`` is that of ``parts``. Edges are reduced to distinct pairs of a fragment and a chunk before parts are looked up.
    """
    cut = fragments(parts)
    own_ranges = owners(parts.select("part", "vid_begin", "vid_end").dropDuplicates(["part"]), cut).select("part", "fragment")

    def counted(own: str, other: str, name: str) -> DataFrame:
        near = chunk_of(edges.select("src", "dst"), own, cut).withColumnRenamed("fragment", "near")
        pairs = chunk_of(near, other, chunk_table).select("near", "chunk", "fragment").distinct()
        remote = pairs.join(own_ranges.withColumnRenamed("fragment", "near"), "near").join(own_ranges, ["part", "fragment"], "left_anti")
        return remote.groupBy("part").agg(F.countDistinct("chunk").alias(name))

    both = parts.select("part").distinct().join(counted("dst", "src", "activations"), "part", "left").join(counted("src", "dst", "gradients"), "part", "left")
    return both.select("part", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("activations", "gradients")))


def mirror_rows(edges: DataFrame, part_of, chunk_table: DataFrame) -> DataFrame:
    """``chunk, receiver, rows``: vertices of each chunk that the receiver holds as mirrors, which is all that is sent to it."""
    return chunk_of(incoming_mirrors(edges, part_of), "v", chunk_table).groupBy("chunk", F.col("part").alias("receiver")).agg(F.count("*").alias("rows"))


def graph_volume(edges: DataFrame, part_of, layers: int, hidden: int, features: int) -> DataFrame:
    """``mirrors, megabytes`` moved when the graph is parted: both directions, the first layer at feature width, the others at hidden width."""
    width = features + hidden * (layers - 1)
    return outgoing_mirrors(edges, part_of).agg(F.count("*").alias("mirrors"), (F.count("*") * float(BYTES * width * 2) / MEGABYTE).alias("megabytes"))


def layer_volume(vertices: int, parts: int, hidden: int) -> float:
    """Megabytes moved when layers are parted."""
    return (parts - 1) * vertices * hidden * BYTES * 2 / MEGABYTE


def split_counts(edges: DataFrame, vertices: int, steps: int = 32) -> DataFrame:
    """``t, crossing`` for thresholds t times a ``steps``-th of the vertices: edges with ends on both sides.

    An edge crosses the thresholds between its ends, so that one pass counts where edges begin and stop crossing; no edge is
    compared with all thresholds.
    """
    unit = max(1, vertices // steps)
    last = steps - 1
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    first = F.floor(low / unit) + 1
    stop = F.least(F.floor(high / unit), F.lit(last))
    marks = edges.select(first.cast("long").alias("a"), stop.cast("long").alias("b")).filter("a <= b")
    steps_ = marks.select(F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("t"), F.lit(-1).alias("d")))).alias("x"))
    deltas = steps_.groupBy(F.col("x.t").alias("t")).agg(F.sum("x.d").alias("d"))
    all_t = edges.sparkSession.range(1, steps).select(F.col("id").alias("t"))
    joined = all_t.join(deltas, "t", "left").select("t", F.coalesce("d", F.lit(0)).alias("d"))
    return joined.select("t", F.sum("d").over(Window.orderBy("t")).cast("long").alias("crossing"))


def best_split(edges: DataFrame, vertices: int, steps: int = 32) -> DataFrame:
    return split_counts(edges, vertices, steps).orderBy("crossing", "t").limit(1)
