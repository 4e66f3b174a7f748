"""Writers of the text formats. ``single`` gives one file, as readers of the formats expect; without it, parts that list in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.graph import sorted_by


def _lines(df: DataFrame, line: Column, path: str, single: bool) -> None:
    out = df.select(line.alias("value"))
    (out.coalesce(1) if single else out).write.mode("errorifexists").text(path)


def write_edges(edges: DataFrame, path: str, single: bool = False) -> None:
    """``src dst 0``, into the folders ``by_src`` and ``by_dst`` under ``path``: the two sorted copies."""
    for end in ("src", "dst"):
        _lines(sorted_by(edges, end), F.concat_ws(" ", "src", "dst", F.lit("0")), f"{path}/by_{end}", single)


def write_features(features: DataFrame, path: str, single: bool = False) -> None:
    number = lambda x: F.format_string("%.10f", x)
    _lines(features.orderBy("v"), F.concat_ws(" ", "v", F.array_join(F.transform("h", number), " ")), path, single)


def write_labels(labels: DataFrame, path: str, single: bool = False) -> None:
    _lines(labels.orderBy("v"), F.concat_ws(" ", "v", F.array_join(F.transform("y", lambda x: x.cast("int")), " ")), path, single)


def write_meta(meta: DataFrame, path: str) -> None:
    _lines(meta, F.concat_ws(" ", "num_vertices", "num_edges", "num_features", "num_labels"), path, True)


def write_mapping(mapping: DataFrame, path: str, single: bool = False) -> None:
    _lines(mapping.orderBy("old"), F.concat_ws(" ", "old", "new"), path, single)
