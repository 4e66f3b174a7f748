import numpy as np
import pytest

from vertexloom.sources import binary, text, writers


def put(path, content):
    path.write_bytes(content.encode())
    return str(path)


def test_text_round_trip(spark, tmp_path):
    assert text.read_meta(spark, put(tmp_path / "meta", "4 3 2 2\n")).first().asDict() == {"num_vertices": 4, "num_edges": 3, "num_features": 2, "num_labels": 2}
    edges = text.read_edges(spark, put(tmp_path / "edges", "0 1 0\r\n0 2 0\r\n2 1 0\r\n0 1 0\r\n2 1 0\r\n0 2 0\r\n"))
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(0, 1), (0, 2), (2, 1)]
    features = text.read_vectors(spark, put(tmp_path / "features", "1 3 4\n0 1 2\n"), width=2)
    assert {r.v: r.h for r in features.collect()} == {0: [1, 2], 1: [3, 4]}
    writers.write_edges(edges, str(tmp_path / "out"), single=True)
    lines = [x for f in sorted((tmp_path / "out/by_dst").glob("part*")) for x in f.read_text().splitlines()]
    assert lines == ["0 1 0", "2 1 0", "0 2 0"]
    writers.write_features(features, str(tmp_path / "f"), single=True)
    assert next((tmp_path / "f").glob("part*")).read_text() == "0 1.0000000000 2.0000000000\n1 3.0000000000 4.0000000000\n"


def test_broken_rows_raise(spark, tmp_path):
    with pytest.raises(Exception, match="bad row"):
        text.read_vectors(spark, put(tmp_path / "a", "0 1 2\n1 3\n"), width=2).collect()
    with pytest.raises(Exception, match="bad row"):
        text.read_vectors(spark, put(tmp_path / "b", "0 1 nan\n"), width=2).collect()
    with pytest.raises(Exception, match="listed"):
        text.read_edges(spark, put(tmp_path / "c", "0 1 0\n")).collect()


def test_partition_and_raw(spark, tmp_path):
    first, second = text.read_partition(spark, put(tmp_path / "part", "0 1\n1 0\n2 1\n1 5\n2 6\n"), 3)
    assert {r.v: r.part for r in first.collect()} == {0: 1, 1: 0, 2: 1}
    assert {r.part: (r.n_vertices, r.n_edges) for r in second.collect()} == {0: (1, 5), 1: (2, 6)}
    assert {r.v: r.part for r in text.read_part_vector(spark, put(tmp_path / "vec", "3\n1\n2\n")).collect()} == {0: 3, 1: 1, 2: 2}
    raw = text.read_raw_edges(spark, put(tmp_path / "raw", "# comment\n1\t2\n5\t1\n"))
    assert {(r.src, r.dst) for r in raw.collect()} == {(1, 2), (5, 1)}
    features = text.read_vectors(spark, put(tmp_path / "f", "0 1\n1 2\n2 3\n"))
    assert {r.v for r in text.owned_rows(features, first, 1).collect()} == {0, 2}


def test_binary(spark, tmp_path):
    rows = np.array([(0, 1, 0.5), (4_000_000_000, 2, 0.25)], binary.RECORD)
    (tmp_path / "e.bin").write_bytes(rows.tobytes())
    edges = binary.read_edges(spark, str(tmp_path / "e.bin"))
    assert {(r.src, r.dst, r.norm) for r in edges.collect()} == {(0, 1, 0.5), (4_000_000_000, 2, 0.25)}
    assert binary.vertex_count(edges) == 4_000_000_001
    binary.write_edges(edges.select("src", "dst", edges.norm.alias("w")).repartition(2), str(tmp_path / "again"))
    files = sorted((tmp_path / "again").glob("part-*.bin"))
    assert len(files) == 2 and sorted(b"".join(f.read_bytes() for f in files)) == sorted(rows.tobytes())
    assert {(r.src, r.dst, r.norm) for r in binary.read_edges(spark, str(tmp_path / "again")).collect()} == {(0, 1, 0.5), (4_000_000_000, 2, 0.25)}


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """A file in many splits gives the numbers that reading it in order gives."""
    parts = [(i * 7919) % 13 for i in range(5000)]
    path = put(tmp_path / "vec", "\n".join(map(str, parts)) + "\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = text.read_part_vector(spark, path)
        assert rows.select("v").distinct().count() == 5000 and {r.v: r.part for r in rows.collect()} == dict(enumerate(parts))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_labels_meta_and_mapping(spark, tmp_path):
    labels = spark.createDataFrame([(1, [0.0, 1.0]), (0, [1.0, 0.0])], "v long, y array<double>")
    writers.write_labels(labels, str(tmp_path / "l"), single=True)
    assert {r.v: r.y for r in text.read_vectors(spark, str(tmp_path / "l"), "y", 2).collect()} == {0: [1, 0], 1: [0, 1]}
    meta = spark.createDataFrame([(4, 3, 2, 2)], "num_vertices long, num_edges long, num_features long, num_labels long")
    writers.write_meta(meta, str(tmp_path / "m"))
    assert text.read_meta(spark, str(tmp_path / "m")).collect() == meta.collect()
    mapping = spark.createDataFrame([(5, 0), (2, 1)], "old long, new long")
    writers.write_mapping(mapping, str(tmp_path / "map"))
    assert set(text.read_mapping(spark, str(tmp_path / "map")).collect()) == set(mapping.collect())
