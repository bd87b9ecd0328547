"""Line formats by short name: ranges of bytes, commits and aborts."""

import io
import os

import pytest
from pyspark.sql import functions as F

from wingtally.sources import datasource, tracks


@pytest.fixture(scope="module")
def known(spark):
    datasource.register(spark)
    return spark


def rows_of(spark, n=500):
    return spark.range(n).selectExpr("id div 3 as frame", "if(id % 7 = 0, null, id % 11) as track_id", "id * 0.25D as x1", "id * 0.5D as y1", "id * 0.25D + 3.5D as x2", "id * 0.5D + 8 as y2", "round(id % 100 / 100, 2) as confidence", "id % 4 as class_id")


def test_ranges_share_out_every_line():
    for text in (b"", b"a", b"a\n", b"\n\na\n", b"first\nsecond line\n\nlast", b"x" * 100 + b"\n" + b"y" * 5):
        want, at = [], 0
        for line in text.split(b"\n")[: None if text[-1:] != b"\n" else -1]:
            if at < len(text):
                want.append((at, line))
            at += len(line) + 1
        for size in (1, 2, 3, 7, 50, 500):
            for block in (1, 4, 1 << 20):
                got = [x for b in range(0, len(text), size) for x in datasource.lines_of(io.BytesIO(text), b, min(b + size, len(text)), len(text), block)]
                assert got == want, (text, size, block)


@pytest.mark.parametrize("name", ["survey_mot", "survey_detections"])
def test_there_and_back(known, tmp_path, name):
    rows = rows_of(known)
    path = f"file://{tmp_path}/{name}"
    rows.repartition(4).write.format(name).mode("append").save(path)
    columns = [c for c in rows.columns if c != "track_id" or name == "survey_mot"]
    back = known.read.format(name).option("range_bytes", 700).load(path)
    assert back.rdd.getNumPartitions() > 8
    assert sorted(map(str, back.select(*columns).collect())) == sorted(map(str, rows.select(*columns).collect()))
    assert back.groupBy("file", "row_id").count().where("count > 1").isEmpty()
    rows.write.format(name).mode("append").save(path)
    assert known.read.format(name).load(path).count() == 1000
    rows.limit(5).write.format(name).mode("overwrite").save(path)
    assert known.read.format(name).load(path).count() == 5
    assert all(f.startswith("part-") for f in os.listdir(tmp_path / name))


def test_same_rows_as_the_plain_reader(known, tmp_path):
    tracks.write_detections(rows_of(known).withColumn("row_id", F.monotonically_increasing_id()), f"file://{tmp_path}/d")
    columns = ["frame", "x1", "y1", "x2", "y2", "confidence", "class_id"]
    plain, by_name = tracks.read_detections(known, f"file://{tmp_path}/d"), known.read.format("survey_detections").option("range_bytes", 999).load(f"file://{tmp_path}/d")
    assert sorted(map(tuple, plain.select(*columns).collect())) == sorted(map(tuple, by_name.select(*columns).collect()))


def test_a_failed_task_leaves_no_file(known, tmp_path):
    bad = rows_of(known).repartition(4).withColumn("x1", F.when((F.col("frame") == 100), F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("x1")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("survey_mot").mode("append").save(f"file://{tmp_path}/out")
    left = [f for _, _, files in os.walk(tmp_path) for f in files]
    assert left == []
    with pytest.raises(Exception, match="missing"):
        rows_of(known).drop("x2").write.format("survey_mot").mode("append").save(f"file://{tmp_path}/out")
    (tmp_path / "none").mkdir()
    assert known.read.format("survey_mot").load(f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        known.read.format("survey_mot").load(f"file://{tmp_path}/nowhere").count()
