"""The library's queries over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators import graph as G
from vertexloom.operators import losses as L
from vertexloom.operators import optim
from vertexloom.operators import partition as P
from vertexloom.operators import tensor as X
from vertexloom.plans.model import GCN
from vertexloom.plans.train import train
from vertexloom.sources import binary, text, writers
from vertexloom.sources import tables as T
from vertexloom.sources.tables import CLASSES, FEATURES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARTS = 4
CHUNK = 16


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir), with its SQL if there is any."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def rnd(c: Column | str, digits: int = 4) -> Column:
    return F.round(c, digits) + 0.0


def settled(c: Column) -> Column:
    """Rounded to four places after a small shift: sums of short decimals often lie on a half, where their order would decide."""
    return F.round(c + 1e-7, 4) + 0.0


def formula(rows: int, columns: int) -> np.ndarray:
    """Fixed weights that both dialects can compute."""
    k, j = np.meshgrid(np.arange(rows), np.arange(columns), indexing="ij")
    return ((7 * k + 3 * j + k * j) % 11 - 5) / 10.0


W_SQL = "(((7*k+3*j+k*j) % 11)-5)/10.0"
_TAIL = """
deg AS (SELECT v.v, COALESCE(i.c,0) AS d_in, COALESCE(o.c,0) AS d_out FROM v
  LEFT JOIN (SELECT dst, count(*) c FROM e GROUP BY 1) i ON i.dst=v.v LEFT JOIN (SELECT src, count(*) c FROM e GROUP BY 1) o ON o.src=v.v),
a AS (SELECT e.src, e.dst, 1/(sqrt(1.0+p.d_in)*sqrt(1.0+q.d_in)) AS w FROM e JOIN deg p ON p.v=e.src JOIN deg q ON q.v=e.dst),
aug AS (SELECT src,dst,w FROM a UNION ALL SELECT v,v,1.0/(1.0+d_in) FROM deg)"""
SUPPLY = """WITH n AS (SELECT count(*) AS s FROM supplier),
e AS (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS src, CAST(l_partkey AS BIGINT)+(SELECT s FROM n) AS dst FROM lineitem),
v AS (SELECT CAST(s_suppkey AS BIGINT) AS v, s_acctbal AS x FROM supplier UNION ALL SELECT p_partkey+(SELECT s FROM n), p_retailprice FROM part),""" + _TAIL
MARKET = """WITH n AS (SELECT count(*) AS c FROM customer),
e AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS src, CAST(l_suppkey AS BIGINT)+(SELECT c FROM n) AS dst FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
v AS (SELECT CAST(c_custkey AS BIGINT) AS v, c_acctbal AS x FROM customer UNION ALL SELECT CAST(s_suppkey AS BIGINT)+(SELECT c FROM n), s_acctbal FROM supplier),""" + _TAIL
SESSION = """WITH l AS (SELECT CAST(user_id AS BIGINT) AS src, lead(CAST(user_id AS BIGINT)) OVER (ORDER BY ts, event_id) AS dst FROM events),
e AS (SELECT src, dst FROM l WHERE dst IS NOT NULL), v AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS v FROM events),""" + _TAIL
VECTORS = f"""WITH n AS (SELECT count(*) AS n FROM embeddings),
e AS (SELECT DISTINCT src, dst FROM (SELECT vec_id AS src, (m.a*vec_id+m.b) % (SELECT n FROM n) AS dst FROM embeddings, (VALUES (7,1),(13,5),(31,11)) m(a,b)) WHERE src<>dst),
v AS (SELECT vec_id AS v, label FROM embeddings),{_TAIL},
h AS (SELECT vec_id AS v, CAST(k AS BIGINT) AS k, CAST(embedding[k+1] AS DOUBLE) AS x FROM embeddings, range({FEATURES}) r(k)),
w1 AS (SELECT k, j, {W_SQL} AS w FROM range({FEATURES}) r(k), range({CLASSES}) q(j)),
y AS (SELECT vec_id AS v, CAST(k AS BIGINT) AS k, CASE WHEN k=label THEN 1.0 ELSE 0.0 END AS s FROM embeddings, range({CLASSES}) r(k)),
z AS (SELECT h.v, w1.j AS k, sum(h.x*w1.w) AS x FROM h JOIN w1 ON w1.k=h.k GROUP BY 1,2),
g AS (SELECT aug.dst AS v, z.k, sum(aug.w*z.x) AS x FROM aug JOIN z ON z.v=aug.src GROUP BY 1,2),
ex AS (SELECT v, k, exp(x-max(x) OVER (PARTITION BY v)) AS x FROM g),
p AS (SELECT v, k, x/sum(x) OVER (PARTITION BY v) AS x FROM ex)"""



def _layer(s: SparkSession, d: str) -> dict:
    """One layer over the vector graph: products, neighbour sums, softmax, and the truth beside it."""
    g, n = T.vectors(s, d)
    x = g.vertices.select("v", "h")
    aug = G.augmented_edges(g)
    z = X.matmul(x, formula(FEATURES, CLASSES))
    sums = X.aggregate(aug, z, CLASSES)
    p = X.softmax(sums)
    return {"graph": g, "n": n, "x": x, "aug": aug, "z": z, "sums": sums, "p": p, "pairs": L.paired(p, g.vertices), "raw": L.paired(sums, g.vertices)}


# Structure


@query(f"{SUPPLY} SELECT src, dst FROM e")
def edges_distinct(s, d):
    return T.supply(s, d).edges


@query(f"{MARKET} SELECT dst, count(*) AS n FROM e GROUP BY 1")
def market_in_degree(s, d):
    return T.market(s, d).edges.groupBy("dst").agg(F.count("*").alias("n"))


@query(f"{SESSION} SELECT v, CAST(d_in AS BIGINT) AS d_in, CAST(d_out AS BIGINT) AS d_out FROM deg")
def in_out_degree(s, d):
    return G.degrees(T.sessions(s, d))


@query(f"{SUPPLY} SELECT src, dst, round(w,6) AS w FROM a")
def edge_norm(s, d):
    return G.normalised_edges(T.supply(s, d)).select("src", "dst", rnd("w", 6).alias("w"))


@query(f"{SESSION} SELECT v AS src, v AS dst, round(1.0/(1.0+d_in),6) AS w FROM deg")
def self_loop_edges(s, d):
    return G.self_edges(G.degrees(T.sessions(s, d))).select("src", "dst", rnd("w", 6).alias("w"))


@query(f"{SUPPLY} SELECT src, dst, round(w,6) AS w FROM a WHERE dst=(SELECT s FROM n)+5")
def neighbors_in(s, d):
    g = T.supply(s, d)
    return G.in_neighbours(G.normalised_edges(g), T.table(s, d, "supplier").count() + 5).select("src", "dst", rnd("w", 6).alias("w"))


@query(f"{SUPPLY} SELECT src, dst, round(w,6) AS w FROM a WHERE src=3")
def neighbors_out(s, d):
    return G.out_neighbours(G.normalised_edges(T.supply(s, d)), 3).select("src", "dst", rnd("w", 6).alias("w"))


@query(f"{SESSION} SELECT v, CAST(COALESCE(sum(d_out) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS out_offset, CAST(COALESCE(sum(d_in) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS in_offset FROM deg")
def csr_offsets(s, d):
    return G.row_offsets(T.sessions(s, d))


@query(f"{SUPPLY} SELECT v, CAST(COALESCE(sum(d_in+1) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS row_offset, CAST(d_in+1 AS BIGINT) AS nnz FROM deg")
def csr_diag_nnz(s, d):
    return G.diagonal_rows(T.supply(s, d))


@query(f"{VECTORS} SELECT src, dst, round(w,6) AS w FROM aug WHERE dst>=100 AND dst<200")
def csr_slice(s, d):
    return G.slice_rows(G.augmented_edges(T.vectors(s, d)[0]), 100, 200).select("src", "dst", rnd("w", 6).alias("w"))


@query("SELECT CAST(0 AS BIGINT) AS faults")
def structure_check(s, d):
    g = T.sessions(s, d)
    return G.weight_faults(g, G.normalised_edges(g)).agg(F.count("*").alias("faults"))


@query(f"{SESSION} SELECT v, v>=100 AND v<300 AS is_local FROM v")
def local_vertices(s, d):
    return T.sessions(s, d).vertices.select("v", G.is_local(F.col("v"), 100, 300).alias("is_local"))


@query(f"{SESSION} SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM e WHERE src=dst) AS self_loops")
def graph_counts(s, d):
    g = T.sessions(s, d)
    e = g.edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    return e.withColumn("n_vertices", F.lit(g.vertices.count()).cast("long")).select("n_vertices", "n_edges", "self_loops")


@query(f"{SUPPLY}, l AS (SELECT v, 0 AS m FROM v WHERE v%{PARTS}=1 UNION ALL SELECT DISTINCT src, 1 FROM e WHERE dst%{PARTS}=1 AND src%{PARTS}<>1) SELECT v, CAST(m AS BIGINT) AS is_mirror, row_number() OVER (ORDER BY m, v)-1 AS local FROM l")
def local_graph_ids(s, d):
    g = T.supply(s, d)
    return P.local_ids(g.vertices, g.edges, lambda v: v % PARTS, 1)


# Neighbour sums

_SUM = "SELECT aug.dst AS v, round(sum(aug.w*v.x)+1e-7,4)+0.0 AS x FROM aug JOIN v ON v.v=aug.src GROUP BY 1"


def _scalar(g: G.Graph) -> DataFrame:
    return X.aggregate(G.augmented_edges(g), g.vertices.select("v", F.array("x").alias("h")), 1).select("v", settled(F.col("h")[0]).alias("x"))


@query(f"{SUPPLY} {_SUM}")
def aggregate_norm_sum(s, d):
    return _scalar(T.supply(s, d))


@query(f"{MARKET} {_SUM}")
def aggregate_norm_sum_market(s, d):
    return _scalar(T.market(s, d))


@query(f"{SESSION} SELECT aug.dst AS v, round(sum(aug.w*(aug.src%7))+1e-7,4)+0.0 AS x FROM aug GROUP BY 1")
def aggregate_norm_sum_multi(s, d):
    g = T.sessions(s, d)
    x = g.vertices.select("v", F.array((F.col("v") % 7).cast("double")).alias("h"))
    return X.aggregate(G.augmented_edges(g), x, 1).select("v", settled(F.col("h")[0]).alias("x"))


@query(f"{VECTORS} SELECT aug.dst AS v, h.k, round(sum(aug.w*h.x),4)+0.0 AS x FROM aug JOIN h ON h.v=aug.src GROUP BY 1,2")
def aggregate_norm_sum_vec(s, d):
    g, _ = T.vectors(s, d)
    return X.long(X.aggregate(G.augmented_edges(g), g.vertices.select("v", "h"), FEATURES))


def _pool(kind: str, sql: str) -> None:
    @query(f"{VECTORS} SELECT e.dst AS v, h.k, round({sql}(h.x),4)+0.0 AS x FROM e JOIN h ON h.v=e.src GROUP BY 1,2", f"aggregate_{kind}")
    def pooled(s, d):
        g, _ = T.vectors(s, d)
        return X.long(X.aggregate(g.edges, g.vertices.select("v", "h"), FEATURES, kind))


for _kind, _sql in (("sum", "sum"), ("mean", "avg"), ("max", "max"), ("min", "min")):
    _pool(_kind, _sql)


@query(f"{SUPPLY} SELECT aug.src AS v, round(sum(aug.w*v.x)+1e-7,4)+0.0 AS x FROM aug JOIN v ON v.v=aug.dst GROUP BY 1")
def aggregate_backward(s, d):
    g = T.supply(s, d)
    return X.aggregate_gradient(G.augmented_edges(g), g.vertices.select("v", F.array("x").alias("h")), 1).select("v", settled(F.col("h")[0]).alias("x"))


# Tensor operators


@query(f"{VECTORS} SELECT v, k, round(x,4)+0.0 AS x FROM h")
def input_features(s, d):
    return X.long(T.vectors(s, d)[0].vertices.select("v", "h"))


@query(f"{VECTORS} SELECT v, k, s AS x FROM y")
def one_hot_labels(s, d):
    return X.long(T.vectors(s, d)[0].vertices.select("v", F.col("y").alias("h")))


@query(f"{VECTORS} SELECT v, k, round(greatest(x,0),4)+0.0 AS x FROM h WHERE v>=50 AND v<150")
def row_range(s, d):
    return X.long(X.relu(X.row_range(T.vectors(s, d)[0].vertices.select("v", "h"), 50, 150)))


@query(f"{VECTORS} SELECT v, k, round(greatest(x,0),4)+0.0 AS x FROM h")
def relu_fwd(s, d):
    return X.long(X.relu(T.vectors(s, d)[0].vertices.select("v", "h")))


@query(f"{VECTORS} SELECT v, k, CASE WHEN x>0 THEN CAST((v+k)%5 AS DOUBLE) ELSE 0.0 END AS x FROM h")
def relu_bwd(s, d):
    x = T.vectors(s, d)[0].vertices.select("v", "h")
    dy = x.select("v", F.transform("h", lambda _, i: ((F.col("v") + i) % 5).cast("double")).alias("h"))
    return X.long(X.relu_gradient(x, dy))


@query(f"{VECTORS} SELECT v, k, round(x,4)+0.0 AS x FROM z")
def matmul_fwd(s, d):
    return X.long(X.matmul(T.vectors(s, d)[0].vertices.select("v", "h"), formula(FEATURES, CLASSES)))


@query(f"{VECTORS} SELECT v, k, round(x,4)+0.0 AS x FROM (SELECT h.v, j AS k, sum(h.x*{W_SQL.replace('k', 'h.k')}) AS x FROM h, range(48) q(j) GROUP BY 1,2)")
def matmul_fwd_blas(s, d):
    return X.long(X.matmul(T.vectors(s, d)[0].vertices.select("v", "h"), formula(FEATURES, 48)))


@query(f"{VECTORS} SELECT y.v, w1.k, round(sum((y.s-0.1)*w1.w),4)+0.0 AS x FROM y JOIN w1 ON w1.j=y.k GROUP BY 1,2")
def matmul_bwd_input(s, d):
    dy = T.vectors(s, d)[0].vertices.select("v", F.transform("y", lambda a: a - 0.1).alias("h"))
    return X.long(X.matmul_input_gradient(dy, formula(FEATURES, CLASSES)))


@query(f"{VECTORS} SELECT h.k, y.k AS j, round(sum(h.x*(y.s-0.1)),4)+0.0 AS g FROM h JOIN y ON y.v=h.v GROUP BY 1,2")
def matmul_bwd_weight(s, d):
    v = T.vectors(s, d)[0].vertices
    dy = v.select("v", F.transform("y", lambda a: a - 0.1).alias("h"))
    return X.matmul_weight_gradient(v.select("v", "h"), dy, FEATURES, CLASSES).select("k", "j", rnd("g").alias("g"))


@query(f"{VECTORS}, m AS (SELECT v,k,exp(x-max(x) OVER (PARTITION BY v)) AS x FROM h) SELECT v, k, round(x/sum(x) OVER (PARTITION BY v),6) AS x FROM m")
def softmax_fwd(s, d):
    return X.long(X.softmax(T.vectors(s, d)[0].vertices.select("v", "h")), 6)


@query(f"{VECTORS} SELECT p.v, p.k, round(p.x*(y.s-sum(p.x*y.s) OVER (PARTITION BY p.v)),6)+0.0 AS x FROM p JOIN y ON y.v=p.v AND y.k=p.k")
def softmax_bwd(s, d):
    m = _layer(s, d)
    return X.long(X.softmax_gradient(m["p"], m["graph"].vertices.select("v", F.col("y").alias("h"))), 6)


@query(f"{VECTORS} SELECT v, k, round(3*greatest(x,0),4)+0.0 AS x FROM h")
def gradient_fan_out(s, d):
    x = X.relu(T.vectors(s, d)[0].vertices.select("v", "h"))
    return X.long(X.accumulated([x, x, x], FEATURES))


@query(f"{VECTORS} SELECT v, k, round(x,4)+0.0 AS x FROM g")
def gcn_layer_fwd(s, d):
    return X.long(_layer(s, d)["sums"])


_TWO = f"""{VECTORS}, z1 AS (SELECT h.v, j AS k, sum(h.x*{W_SQL.replace('k', 'h.k')}) AS x FROM h, range(16) q(j) GROUP BY 1,2),
g1 AS (SELECT aug.dst AS v, z1.k, greatest(sum(aug.w*z1.x),0) AS x FROM aug JOIN z1 ON z1.v=aug.src GROUP BY 1,2),
z2 AS (SELECT g1.v, j AS k, sum(g1.x*{W_SQL.replace('k', 'g1.k')}) AS x FROM g1, range({CLASSES}) q(j) GROUP BY 1,2),
g2 AS (SELECT aug.dst AS v, z2.k, sum(aug.w*z2.x) AS x FROM aug JOIN z2 ON z2.v=aug.src GROUP BY 1,2),
e2 AS (SELECT v, k, exp(x-max(x) OVER (PARTITION BY v)) AS x FROM g2), p2 AS (SELECT v, k, x/sum(x) OVER (PARTITION BY v) AS x FROM e2),
top AS (SELECT v, k FROM (SELECT v, k, row_number() OVER (PARTITION BY v ORDER BY x DESC, k) AS r FROM p2) WHERE r=1)
SELECT round((SELECT sum(-y.s*ln(p2.x+1e-8)) FROM p2 JOIN y ON y.v=p2.v AND y.k=p2.k)/(SELECT n FROM n),4) AS loss, round((SELECT avg(y.s) FROM top JOIN y ON y.v=top.v AND y.k=top.k),6) AS accuracy"""


@query(_TWO)
def gcn2_forward_loss_acc(s, d):
    from vertexloom.plans.train import forward

    g, n = T.vectors(s, d)
    model = GCN(2, 16, CLASSES, FEATURES)
    weights = {o.output.op: formula(*o.output.shape) for o in model.operators if o.kind == "WEIGHT"}
    made = forward(model.plan(), G.augmented_edges(g), g.vertices.select("v", "h"), weights)
    pairs = L.paired(made[model.output.op], g.vertices)
    return pairs.agg(rnd(F.sum(L.cross_entropy()) / float(n)).alias("loss"), rnd(F.avg(F.when(L.hit(), 1.0).otherwise(0.0)), 6).alias("accuracy"))


# Losses and metrics

_PY = "FROM p JOIN y ON y.v=p.v AND y.k=p.k"


@query(f"{VECTORS} SELECT round(sum((p.x-y.s)*(p.x-y.s))/(SELECT n FROM n),6) AS loss {_PY}")
def mse_loss(s, d):
    m = _layer(s, d)
    return L.mean_loss(m["pairs"], L.square_error(), m["n"]).select(rnd("loss", 6).alias("loss"))


@query(f"{VECTORS} SELECT p.v, p.k, round(2*(p.x-y.s)/(SELECT n FROM n),8)+0.0 AS x {_PY}")
def mse_grad(s, d):
    m = _layer(s, d)
    return X.long(L.mse_gradient(m["pairs"], m["n"]), 8)


@query(f"{VECTORS} SELECT round(sum(-y.s*ln(p.x+1e-8))/(SELECT n FROM n),6) AS loss {_PY}")
def ce_loss(s, d):
    m = _layer(s, d)
    return L.mean_loss(m["pairs"], L.cross_entropy(), m["n"]).select(rnd("loss", 6).alias("loss"))


@query(f"{VECTORS} SELECT round(sum(-y.s*ln(p.x+1e-12))/(SELECT n FROM n),6) AS loss {_PY}")
def ce_loss_device(s, d):
    m = _layer(s, d)
    return L.mean_loss(m["pairs"], L.cross_entropy(L.DEVICE_EPSILON), m["n"]).select(rnd("loss", 6).alias("loss"))


@query(f"{VECTORS} SELECT p.v, p.k, round(-y.s/(SELECT n FROM n)/(p.x+1e-8),4)+0.0 AS x {_PY}")
def ce_grad(s, d):
    m = _layer(s, d)
    return X.long(L.cross_entropy_gradient(m["pairs"], m["n"]))


@query(f"{VECTORS} SELECT round(sum(-y.s*ln(p.x))/(SELECT n FROM n),6) AS loss {_PY}")
def ce_fused_loss(s, d):
    m = _layer(s, d)
    return L.mean_loss(m["raw"], L.fused_cross_entropy(), m["n"]).select(rnd("loss", 6).alias("loss"))


@query(f"{VECTORS} SELECT p.v, p.k, round((p.x-y.s)/(SELECT n FROM n),8)+0.0 AS x {_PY}")
def ce_fused_grad(s, d):
    m = _layer(s, d)
    return X.long(L.fused_gradient(m["raw"], m["n"]), 8)


@query(f"{VECTORS} SELECT round(sum(CASE WHEN p.v%3=0 THEN -y.s*ln(p.x+1e-8) ELSE 0 END)/(SELECT n FROM n),6) AS loss {_PY}")
def ce_masked(s, d):
    m = _layer(s, d)
    return L.mean_loss(m["pairs"], L.cross_entropy(), m["n"], F.col("v") % 3 == 0).select(rnd("loss", 6).alias("loss"))


@query(f"{VECTORS} SELECT least(p.v//((SELECT n FROM n)//{CHUNK}),{CHUNK - 1}) AS chunk, round(sum(-y.s*ln(p.x+1e-8))/(SELECT n FROM n),6) AS loss {_PY} GROUP BY 1")
def chunked_loss_sums(s, d):
    m = _layer(s, d)
    return m["pairs"].groupBy(P.equal_chunk(F.col("v"), m["n"], CHUNK).alias("chunk")).agg(rnd(F.sum(L.cross_entropy()) / float(m["n"]), 6).alias("loss"))


_TOP = "top AS (SELECT v, k FROM (SELECT v, k, row_number() OVER (PARTITION BY v ORDER BY x DESC, k) AS r FROM p) WHERE r=1)"


@query(f"{VECTORS}, {_TOP} SELECT round(avg(y.s),6) AS accuracy FROM top JOIN y ON y.v=top.v AND y.k=top.k")
def accuracy(s, d):
    return L.accuracy(_layer(s, d)["pairs"]).select(rnd("accuracy", 6).alias("accuracy"))


@query(f"{VECTORS}, {_TOP} SELECT CAST(v.label AS BIGINT) AS truth, top.k AS predicted, count(*) AS n FROM top JOIN v ON v.v=top.v GROUP BY 1,2")
def confusion_counts(s, d):
    return L.confusion(_layer(s, d)["pairs"])


_PARTED = f"{VECTORS}, {_TOP}, l AS (SELECT p.v%{PARTS} AS part, sum(-y.s*ln(p.x+1e-8)) AS t {_PY} GROUP BY 1), c AS (SELECT top.v%{PARTS} AS part, count(*) AS n, avg(y.s) AS acc FROM top JOIN y ON y.v=top.v AND y.k=top.k GROUP BY 1)"


@query(f"{_PARTED} SELECT CAST(l.part AS BIGINT) AS part, c.n, round(l.t/c.n,6) AS loss, round(c.acc,6) AS accuracy FROM l JOIN c ON c.part=l.part")
def local_metrics(s, d):
    return L.by_part(_layer(s, d)["pairs"], F.col("v") % PARTS, L.cross_entropy()).select("part", "n", rnd("loss", 6).alias("loss"), rnd("accuracy", 6).alias("accuracy"))


@query(f"{_PARTED} SELECT round(sum(l.t)/sum(c.n),6) AS loss, round(sum(c.acc*c.n)/sum(c.n),6) AS accuracy FROM l JOIN c ON c.part=l.part")
def reduced_metrics(s, d):
    parts = L.by_part(_layer(s, d)["pairs"], F.col("v") % PARTS, L.cross_entropy())
    return L.reduced(parts).select(rnd("loss", 6).alias("loss"), rnd("accuracy", 6).alias("accuracy"))


# Optimizers: one or two steps on the last layer's weights

_GRAD = f"{VECTORS}, d AS (SELECT p.v, p.k, (p.x-y.s)/(SELECT n FROM n) AS x {_PY}), b AS (SELECT aug.src AS v, d.k, sum(aug.w*d.x) AS x FROM aug JOIN d ON d.v=aug.dst GROUP BY 1,2), gw AS (SELECT h.k, b.k AS j, sum(h.x*b.x) AS g FROM h JOIN b ON b.v=h.v GROUP BY 1,2)"


def _gradient(s: SparkSession, d: str) -> DataFrame:
    m = _layer(s, d)
    back = X.aggregate_gradient(m["aug"], L.fused_gradient(m["raw"], m["n"]), CLASSES)
    return X.matmul_weight_gradient(m["x"], back, FEATURES, CLASSES)


def _weights_table(s: SparkSession, w: np.ndarray, digits: int = 6) -> DataFrame:
    rows = [(int(k), int(j), float(w[k, j])) for k in range(w.shape[0]) for j in range(w.shape[1])]
    return s.createDataFrame(rows, "k long, j long, w double").select("k", "j", rnd("w", digits).alias("w"))


def _dense(s, d) -> np.ndarray:
    from vertexloom.plans.train import dense

    return dense({0: _gradient(s, d)}, {0: np.zeros((FEATURES, CLASSES))})[0]


@query(f"{_GRAD} SELECT k, j, round(g,6)+0.0 AS g FROM gw")
def weight_gradient(s, d):
    return _gradient(s, d).select("k", "j", rnd("g", 6).alias("g"))


@query(f"{_GRAD} SELECT gw.k, gw.j, round(w1.w-0.3*g,6)+0.0 AS w FROM gw JOIN w1 ON w1.k=gw.k AND w1.j=gw.j")
def sgd_step(s, d):
    return _weights_table(s, optim.SGD(0.3).step("w", formula(FEATURES, CLASSES), _dense(s, d)))


def _adam(correct: str) -> None:
    two = "1-0.9*0.9" if correct == "standard" else "1-0.9"
    sq = "1-0.999*0.999" if correct == "standard" else "1-0.999"
    sql = f"""{_GRAD}, a1 AS (SELECT gw.k, gw.j, g, w1.w AS w0, 0.1*g AS m1, 0.001*g*g AS v1 FROM gw JOIN w1 ON w1.k=gw.k AND w1.j=gw.j),
a2 AS (SELECT *, w0-0.005*(m1/(1-0.9))/(sqrt(v1/(1-0.999))+1e-8) AS s1, 0.9*m1+0.1*(0.5*g) AS m2, 0.999*v1+0.001*(0.5*g)*(0.5*g) AS v2 FROM a1)
SELECT k, j, round(s1-0.005*(m2/({two}))/(sqrt(v2/({sq}))+1e-8),6)+0.0 AS w FROM a2"""

    @query(sql, f"adam_step_{correct}")
    def step(s, d):
        g, adam = _dense(s, d), optim.Adam(0.005, bias_correction=correct)
        return _weights_table(s, adam.step("w", adam.step("w", formula(FEATURES, CLASSES), g), 0.5 * g))


for _c in ("frozen", "standard"):
    _adam(_c)


@query(f"{_GRAD} SELECT k, j, round(greatest(least(g*1000,2),-2),4)+0.0 AS g FROM gw")
def clip_grad(s, d):
    return _weights_table(s, optim.clipped(1000 * _dense(s, d)), 4).withColumnRenamed("w", "g")


@query(None)
def weight_init(s, d):
    """Weights of a 64 by 10 layer as first drawn."""
    from vertexloom.functions.random import glorot

    return _weights_table(s, glorot(FEATURES, CLASSES), 10)


_PLATEAU = """WITH RECURSIVE l AS (SELECT row_number() OVER (ORDER BY hour) AS t, x FROM (SELECT floor(epoch(ts)/3600) AS hour, min(value) AS x FROM events GROUP BY 1)),
r AS (SELECT CAST(0 AS BIGINT) AS t, 0.1::DOUBLE AS rate, 3.4028234663852886e38::DOUBLE AS best, 0 AS bad, 0 AS wait
UNION ALL SELECT t, CASE WHEN bad>3 AND rate-greatest(rate*0.8,0.001)>1e-8 THEN greatest(rate*0.8,0.001) ELSE rate END, best, CASE WHEN bad>3 THEN 0 ELSE bad END, CASE WHEN bad>3 THEN 2 ELSE wait END
FROM (SELECT l.t, r.rate, least(r.best,l.x) AS best, CASE WHEN r.wait>0 THEN 0 WHEN l.x<r.best THEN 0 ELSE r.bad+1 END AS bad, CASE WHEN r.wait>0 THEN r.wait-1 ELSE 0 END AS wait FROM r JOIN l ON l.t=r.t+1))
SELECT t AS step, round(rate,8) AS rate FROM r WHERE t>0"""


@query(_PLATEAU)
def plateau_scheduler(s, d):
    """The rate after each hour's least value, taken for a loss; a state machine over the driver's metrics, of which there is one for each hour of the events."""
    losses = T.table(s, d, "events").groupBy(F.floor(F.unix_timestamp("ts") / 3600).alias("hour")).agg(F.min("value").alias("value")).orderBy("hour").collect()
    scheduler = optim.PlateauRate(0.1, 0.001, 0.8, 1e-8, 3, 2)
    return s.createDataFrame([(i, round(scheduler.step(r.value), 8)) for i, r in enumerate(losses, 1)], "step long, rate double")


# Placement and communication

_OPS = """ops AS (SELECT * FROM (VALUES (0,'INPUT'),(1,'WEIGHT'),(2,'MATMUL'),(3,'AGGREGATION'),(4,'RELU'),(5,'WEIGHT'),(6,'MATMUL'),(7,'AGGREGATION'),(8,'RELU'),(9,'WEIGHT'),(10,'MATMUL'),(11,'AGGREGATION'),(12,'SOFTMAX')) t(op,kind)),
oe AS (SELECT * FROM (VALUES (0,2),(1,2),(2,3),(3,4),(4,6),(5,6),(6,7),(7,8),(8,10),(9,10),(10,11),(11,12)) t(producer,consumer))"""
_PLACED = f"""{_OPS}, ly AS (SELECT consumer AS op, least((row_number() OVER (ORDER BY consumer)-1)//(count(*) OVER ()//{PARTS}),{PARTS - 1}) AS part FROM (SELECT DISTINCT consumer FROM oe)),
pl AS (SELECT op, part FROM ly UNION ALL SELECT oe.producer, max(ly.part) FROM oe JOIN ly ON ly.op=oe.consumer WHERE oe.producer NOT IN (SELECT op FROM ly) GROUP BY 1)"""


def _ops(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    return GCN(3, 16, CLASSES, FEATURES).tables(s)


@query(f"WITH {_PLACED} SELECT CAST(op AS BIGINT) AS op, CAST(part AS BIGINT) AS part FROM pl")
def op_partition(s, d):
    return P.placed_operators(*_ops(s), PARTS)


@query(f"WITH {_PLACED} SELECT DISTINCT CAST(oe.producer AS BIGINT) AS tensor, CAST(a.part AS BIGINT) AS from_part, CAST(b.part AS BIGINT) AS to_part FROM oe JOIN pl a ON a.op=oe.producer JOIN pl b ON b.op=oe.consumer WHERE a.part<>b.part")
def boundary_tensors(s, d):
    ops, edges = _ops(s)
    return P.boundary_tensors(edges, P.placed_operators(ops, edges, PARTS))


@query(f"WITH {_OPS} SELECT count(*) AS faults FROM oe WHERE producer>=consumer")
def topo_check(s, d):
    return P.order_faults(_ops(s)[1]).agg(F.count("*").alias("faults"))


@query(f"WITH {_OPS} SELECT CAST(op AS BIGINT) AS op, kind, kind='WEIGHT' OR op>1 AS needs_gradient FROM ops")
def backward_mask(s, d):
    model = GCN(3, 16, CLASSES, FEATURES)
    return s.createDataFrame([(o.output.op, o.kind, m) for o, m in zip(model.operators, model.needs_gradient(), strict=True)], "op long, kind string, needs_gradient boolean")


_RANGES = """parts AS (SELECT p.part, CASE WHEN p.part=0 THEN 0 ELSE n//4 END AS vid_begin, CASE WHEN p.part=0 THEN n//4 ELSE n END AS vid_end, p.ob AS op_begin, p.oe AS op_end
FROM (VALUES (0,0,13),(1,0,5),(2,5,9),(3,9,13)) p(part,ob,oe), (SELECT count(*) AS n FROM embeddings))"""


def _ranges(s: SparkSession, n: int) -> DataFrame:
    """One part holds all operators of the first quarter of vertices; the others a third of the operators each of the rest."""
    rows = [(0, 0, n // 4, 0, 13), (1, n // 4, n, 0, 5), (2, n // 4, n, 5, 9), (3, n // 4, n, 9, 13)]
    return s.createDataFrame(rows, "part long, vid_begin long, vid_end long, op_begin long, op_end long")


_FRAG = "ends AS (SELECT DISTINCT vid_begin AS b FROM parts UNION SELECT DISTINCT vid_end FROM parts), frag AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY b)-1 AS fragment, b AS \"begin\", lead(b) OVER (ORDER BY b) AS \"end\" FROM ends) WHERE \"end\" IS NOT NULL)"
_CHUNKS = f"{_FRAG}, chunk AS (SELECT row_number() OVER (ORDER BY b)-1 AS chunk, b AS \"begin\", least(b+40,\"end\") AS \"end\", fragment FROM (SELECT fragment, \"end\", unnest(generate_series(\"begin\",\"end\"-1,40)) AS b FROM frag))"
_BIG = 'CAST("{0}" AS BIGINT) AS "{0}"'


@query(f"WITH {_OPS}, {_RANGES}, c AS (SELECT o.op, p.vid_begin, p.vid_end, lag(vid_end) OVER (PARTITION BY o.op ORDER BY vid_begin,vid_end) AS b FROM ops o JOIN parts p ON o.op>=p.op_begin AND o.op<p.op_end) SELECT CAST(op AS BIGINT) AS op, CAST(sum(vid_end-vid_begin) AS BIGINT) AS covered, CAST(sum(CASE WHEN b>vid_begin THEN 1 ELSE 0 END) AS BIGINT) AS overlaps, sum(vid_end-vid_begin)=(SELECT count(*) FROM embeddings) AND sum(CASE WHEN b>vid_begin THEN 1 ELSE 0 END)=0 AS valid FROM c GROUP BY op")
def partition_valid(s, d):
    n = T.table(s, d, "embeddings").count()
    return P.coverage(_ops(s)[0], _ranges(s, n), n)


@query(f"WITH {_RANGES}, {_FRAG} SELECT {_BIG.format('fragment')}, {_BIG.format('begin')}, {_BIG.format('end')} FROM frag")
def fragments(s, d):
    return P.fragments(_ranges(s, T.table(s, d, "embeddings").count()))


@query(f"WITH {_RANGES}, {_CHUNKS} SELECT {', '.join(map(_BIG.format, ('chunk', 'begin', 'end', 'fragment')))} FROM chunk")
def chunks(s, d):
    return P.chunks(_ranges(s, T.table(s, d, "embeddings").count()), 40)


@query(f"WITH {_RANGES}, {_CHUNKS} SELECT vec_id AS v, {_BIG.format('chunk')}, {_BIG.format('fragment')} FROM embeddings JOIN chunk ON vec_id>=\"begin\" AND vec_id<\"end\"")
def vid_to_chunk(s, d):
    rows = T.table(s, d, "embeddings")
    return P.chunk_of(rows.select(F.col("vec_id").alias("v")), "v", P.chunks(_ranges(s, rows.count()), 40)).select("v", "chunk", "fragment")


@query(f"SELECT least(vec_id//(n//{CHUNK}),{CHUNK - 1}) AS chunk, count(*) AS n FROM embeddings, (SELECT count(*) AS n FROM embeddings) GROUP BY 1")
def equal_chunks(s, d):
    rows = T.table(s, d, "embeddings")
    return rows.groupBy(P.equal_chunk(F.col("vec_id"), rows.count(), CHUNK).alias("chunk")).agg(F.count("*").alias("n"))


@query(f"{SESSION} SELECT DISTINCT dst%{PARTS} AS part, src AS v FROM e WHERE src%{PARTS}<>dst%{PARTS}")
def incoming_mirrors(s, d):
    return P.incoming_mirrors(T.sessions(s, d).edges, lambda v: v % PARTS)


@query(f"{SESSION} SELECT DISTINCT src%{PARTS} AS part, dst AS v FROM e WHERE src%{PARTS}<>dst%{PARTS}")
def outgoing_mirrors(s, d):
    return P.outgoing_mirrors(T.sessions(s, d).edges, lambda v: v % PARTS)


_OWN = 'own AS (SELECT f.fragment, p.* FROM frag f JOIN parts p ON f."begin">=p.vid_begin AND f."end"<=p.vid_end)'
_USED = "used AS (SELECT a.part AS ap, b.part AS bp, a.fragment, oe.producer FROM own a JOIN own b ON a.fragment=b.fragment AND a.part<>b.part JOIN oe ON oe.producer>=b.op_begin AND oe.producer<b.op_end AND oe.consumer>=a.op_begin AND oe.consumer<a.op_end JOIN ops o ON o.op=oe.producer AND o.kind<>'WEIGHT')"


@query(f"WITH {_OPS}, {_RANGES}, {_FRAG}, {_OWN}, {_USED} SELECT DISTINCT 'forward' AS direction, CAST(ap AS BIGINT) AS part, CAST(fragment AS BIGINT) AS fragment, CAST(bp AS BIGINT) AS peer, CAST(producer AS BIGINT) AS tensor FROM used UNION ALL SELECT DISTINCT 'backward', CAST(bp AS BIGINT), CAST(fragment AS BIGINT), CAST(ap AS BIGINT), CAST(producer AS BIGINT) FROM used")
def p_link_deps(s, d):
    return P.stage_links(*_ops(s), _ranges(s, T.table(s, d, "embeddings").count()))


_PAIRS = "pr AS (SELECT DISTINCT a.part, b.part AS peer FROM e JOIN parts a ON e.src>=a.vid_begin AND e.src<a.vid_end JOIN parts b ON e.dst>=b.vid_begin AND e.dst<b.vid_end WHERE a.part<>b.part)"


@query(f"""{VECTORS}, {_OPS}, {_RANGES}, {_PAIRS}
SELECT DISTINCT 'activation' AS direction, CAST(pr.part AS BIGINT) AS part, CAST(pr.peer AS BIGINT) AS peer, CAST(oe.producer AS BIGINT) AS tensor FROM pr JOIN parts m ON m.part=pr.part JOIN parts t ON t.part=pr.peer JOIN oe ON oe.producer>=m.op_begin AND oe.producer<m.op_end AND oe.consumer>=t.op_begin AND oe.consumer<t.op_end JOIN ops o ON o.op=oe.consumer AND o.kind='AGGREGATION'
UNION ALL SELECT DISTINCT 'gradient', CAST(pr.peer AS BIGINT), CAST(pr.part AS BIGINT), CAST(o.op AS BIGINT) FROM pr JOIN parts m ON m.part=pr.peer JOIN parts t ON t.part=pr.part JOIN ops o ON o.kind='AGGREGATION' AND o.op>=greatest(m.op_begin,t.op_begin) AND o.op<least(m.op_end,t.op_end)""")
def i_link_deps(s, d):
    g, n = T.vectors(s, d)
    return P.graph_links(*_ops(s), _ranges(s, n), g.edges)


def _received(own: str, other: str) -> str:
    return f'(SELECT p.part, count(DISTINCT c.chunk) AS n FROM parts p JOIN e ON e.{own}>=p.vid_begin AND e.{own}<p.vid_end AND NOT (e.{other}>=p.vid_begin AND e.{other}<p.vid_end) JOIN chunk c ON e.{other}>=c."begin" AND e.{other}<c."end" GROUP BY 1)'


@query(f"{VECTORS}, {_RANGES}, {_CHUNKS} SELECT CAST(p.part AS BIGINT) AS part, COALESCE(a.n,0) AS activations, COALESCE(b.n,0) AS gradients FROM parts p LEFT JOIN {_received('dst', 'src')} a ON a.part=p.part LEFT JOIN {_received('src', 'dst')} b ON b.part=p.part")
def updates_to_recv(s, d):
    g, n = T.vectors(s, d)
    parts = _ranges(s, n)
    return P.updates_to_receive(g.edges, parts, P.chunks(parts, 40))


@query(f"{VECTORS}, {_RANGES}, {_CHUNKS}, m AS (SELECT DISTINCT dst%{PARTS} AS part, src AS v FROM e WHERE src%{PARTS}<>dst%{PARTS}) SELECT CAST(c.chunk AS BIGINT) AS chunk, m.part AS receiver, count(*) AS rows FROM m JOIN chunk c ON m.v>=c.\"begin\" AND m.v<c.\"end\" GROUP BY 1,2")
def mirror_rows_per_chunk(s, d):
    g, n = T.vectors(s, d)
    return P.mirror_rows(g.edges, lambda v: v % PARTS, P.chunks(_ranges(s, n), 40))


@query(f"{SUPPLY}, m AS (SELECT DISTINCT src%{PARTS}, dst FROM e WHERE src%{PARTS}<>dst%{PARTS}) SELECT count(*) AS mirrors, round(count(*)*4.0*(64+16*2)*2/1048576,6) AS megabytes FROM m")
def comm_volume_graph(s, d):
    return P.graph_volume(T.supply(s, d).edges, lambda v: v % PARTS, 3, 16, 64).select("mirrors", rnd("megabytes", 6).alias("megabytes"))


@query(f"{SUPPLY} SELECT round({PARTS - 1}*count(*)*16*4.0*2/1048576,6) AS megabytes FROM v")
def comm_volume_layer(s, d):
    return s.createDataFrame([(round(P.layer_volume(T.supply(s, d).vertices.count(), PARTS, 16), 6),)], "megabytes double")


@query(f"{SESSION} SELECT count(*) AS crossing FROM e, (SELECT count(*) AS n FROM v) WHERE (src<n//2)<>(dst<n//2)")
def cross_edges_balanced(s, d):
    g = T.sessions(s, d)
    half = g.vertices.count() // 2
    return P.cross_edges(g.edges, lambda v: F.when(v < half, 0).otherwise(1)).agg(F.count("*").alias("crossing"))


_SPLIT = f"{SUPPLY}, u AS (SELECT count(*)//32 AS u FROM v), c AS (SELECT t, count(*) FILTER (WHERE (src<t*u)<>(dst<t*u)) AS crossing FROM e, u, range(1,32) r(t) GROUP BY 1)"


@query(f"{_SPLIT} SELECT t, crossing FROM c")
def imbalanced_splits(s, d):
    g = T.supply(s, d)
    return P.split_counts(g.edges, g.vertices.count())


@query(f"{_SPLIT} SELECT t, crossing FROM c ORDER BY crossing, t LIMIT 1")
def best_imbalanced_split(s, d):
    g = T.supply(s, d)
    return P.best_split(g.edges, g.vertices.count())


# Preparation of data sets

_SPARSE = "WITH n AS (SELECT count(*) AS s FROM supplier), e AS (SELECT DISTINCT l_suppkey*3 AS src, (l_partkey+(SELECT s FROM n))*3 AS dst FROM lineitem), m AS (SELECT old, row_number() OVER (ORDER BY old)-1 AS new FROM (SELECT src AS old FROM e UNION SELECT dst FROM e))"


@query(f"{_SPARSE} SELECT CAST(a.new AS BIGINT) AS src, CAST(b.new AS BIGINT) AS dst FROM e JOIN m a ON a.old=e.src JOIN m b ON b.old=e.dst")
def densify_ids(s, d):
    return G.densified(T.sparse(s, d))[0]


@query(f"{_SPARSE} SELECT CAST(old AS BIGINT) AS old, CAST(new AS BIGINT) AS new FROM m")
def densify_mapping(s, d):
    return G.densified(T.sparse(s, d))[1]


_BY_DEGREE = "m AS (SELECT v AS old, row_number() OVER (ORDER BY d_in DESC, v)-1 AS new FROM deg)"


@query(f"{SESSION}, {_BY_DEGREE} SELECT old, new FROM m")
def degree_mapping(s, d):
    return G.degree_order(T.sessions(s, d))


@query(f"{SESSION}, {_BY_DEGREE} SELECT a.new AS src, b.new AS dst FROM e JOIN m a ON a.old=e.src JOIN m b ON b.old=e.dst")
def reorder_by_degree(s, d):
    g = T.sessions(s, d)
    return G.renumbered(g.edges, G.degree_order(g))


@query(f"{SESSION}, {_BY_DEGREE} SELECT a.new AS src, b.new AS dst FROM e JOIN m a ON a.old=e.src JOIN m b ON b.old=e.dst")
def reorder_by_file(s, d):
    """As ``reorder_by_degree``, with the mapping written as text and read back."""
    g, path = T.sessions(s, d), T.scratch(s)
    writers.write_mapping(G.degree_order(g), path)
    return G.renumbered(g.edges, text.read_mapping(s, path))


@query(f"{SUPPLY} SELECT src, dst FROM e")
def edges_through_text(s, d):
    """Edges written as the two sorted copies and read back as one list."""
    path = T.scratch(s)
    writers.write_edges(T.supply(s, d).edges, path)
    return text.read_edges(s, f"{path}/by_*")


@query(f"{SUPPLY} SELECT src, dst FROM e")
def edges_through_binary(s, d):
    """Edges written as packed records, a file for each task, and read back."""
    path = T.scratch(s)
    binary.write_edges(T.supply(s, d).edges.withColumn("w", F.lit(1.0)), path)
    return binary.read_edges(s, path).select("src", "dst")


@query(f"{SUPPLY} SELECT src, dst, row_number() OVER (ORDER BY src,dst)-1 AS by_src, row_number() OVER (ORDER BY dst,src)-1 AS by_dst FROM e")
def edges_sorted_dual(s, d):
    return G.positions(T.supply(s, d).edges)


@query(f"{SUPPLY} SELECT v, CAST(k AS BIGINT) AS k, round(((v*7919+k*104729+15485863)%10007)/10007.0,6) AS x, CASE WHEN (v*31+1)%16=k THEN 1.0 ELSE 0.0 END AS y FROM v, range(16) r(k)")
def synthetic_features(s, d):
    made = G.synthetic(T.supply(s, d).vertices, 16, 16)
    return made.select("v", F.posexplode(F.arrays_zip("h", "y")).alias("k", "z")).select("v", F.col("k").cast("long").alias("k"), rnd("z.h", 6).alias("x"), F.col("z.y").alias("y"))


@query(f"{SUPPLY} SELECT src, dst FROM e ORDER BY md5(concat_ws('-', src, dst, 1)), src, dst LIMIT 3000")
def adjacency_sample(s, d):
    """Three thousand edges, as are drawn for a plot."""
    return G.sampled(T.supply(s, d).edges, 3000)


# Training


def _trained(s: SparkSession, d: str, optimizer, epochs: int, **options) -> DataFrame:
    g, _ = T.vectors(s, d)
    run = train(GCN(2, 16, CLASSES, FEATURES), G.augmented_edges(g), g.vertices.select("v", "h"), g.vertices.select("v", "y"), optimizer, epochs, **options)
    return s.createDataFrame([(e, round(loss, 6), round(a, 6)) for e, loss, a, _ in run.metrics], "epoch int, loss double, accuracy double")


@query(None)
def train_gcn_sgd(s, d):
    return _trained(s, d, optim.SGD(0.3), 4)


@query(None)
def train_gcn_adam(s, d):
    return _trained(s, d, optim.Adam(5e-3), 3, scheduler=optim.PlateauRate(5e-3, patience=1))


@query(None)
def train_per_chunk(s, d):
    return _trained(s, d, optim.SGD(0.3), 1, update="chunk", chunks=4)


@query(None)
def train_last_chunk(s, d):
    return _trained(s, d, optim.SGD(0.3), 2, update="last_chunk", chunks=4)


@query(None)
def train_stale(s, d):
    return _trained(s, d, optim.SGD(0.3), 3, staleness=1)


@query(None)
def train_local_scaling(s, d):
    """Losses divided by a quarter of the vertices, as one of four parts would."""
    return _trained(s, d, optim.SGD(0.3), 2, vertices=T.table(s, d, "embeddings").count() // 4)
