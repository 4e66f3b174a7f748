"""Schemas of the tables that make up a graph data set."""

from pyspark.sql import types as T

META = T.StructType([T.StructField(n, T.LongType(), False) for n in ("num_vertices", "num_edges", "num_features", "num_labels")])
EDGES = T.StructType([T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False)])
WEIGHTED_EDGES = T.StructType([*EDGES.fields, T.StructField("w", T.DoubleType(), False)])
#: A vertex tensor: a row of fixed width for each vertex.
FEATURES = T.StructType([T.StructField("v", T.LongType(), False), T.StructField("h", T.ArrayType(T.DoubleType(), False), False)])
LABELS = T.StructType([T.StructField("v", T.LongType(), False), T.StructField("y", T.ArrayType(T.DoubleType(), False), False)])
PARTITION = T.StructType([T.StructField("v", T.LongType(), False), T.StructField("part", T.IntegerType(), False)])
PARTITION_SIZES = T.StructType([T.StructField("part", T.IntegerType(), False), T.StructField("n_vertices", T.LongType(), False), T.StructField("n_edges", T.LongType(), False)])
METRICS = T.StructType([T.StructField("epoch", T.IntegerType(), False), T.StructField("loss", T.DoubleType(), False), T.StructField("accuracy", T.DoubleType(), False), T.StructField("seconds", T.DoubleType(), False)])
