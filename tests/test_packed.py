"""Packed ids on disk: round trips, order, places, and what failed tasks leave."""

import json
import random

import pyarrow as pa
import pytest

from sparktok.sources import packed


def test_round_trip(spark, tmp_path):
    """Rows out of order, a key that a third of all rows share, empty and null rows, many partitions of few rows."""
    rng = random.Random(3)
    rows = [(k if k % 3 else 300, None if k % 50 == 7 else [rng.randrange(1 << 20) for _ in range(rng.choice((0, 1, 5, 400)))], "x") for k in range(600)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, ids array<int>, extra string").repartition(5)
    path = f"file://{tmp_path}/out"
    packed.write_packed(table, path, ranges=6)
    got = packed.read_packed(spark, path, 37).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(600)) and [r["key"] for r in got] == sorted(k for k, _, _ in rows)
    assert sorted((r["key"], r["ids"]) for r in got) == sorted((k, v or []) for k, v, _ in rows)
    file = packed.PackedFile(path)
    assert len(file) == 600 and file.token_count == sum(len(v or []) for _, v, _ in rows)
    assert all(file[r["place"]].tolist() == r["ids"] for r in got) and file[-1].tolist() == got[-1]["ids"]
    # The shared key goes over several parts.
    assert len({p.stem for p in file.parts if p.first[0] == 300}) > 1
    with pytest.raises(IndexError):
        file[600]
    with pytest.raises(Exception, match="already"):
        packed.write_packed(table, path)
    packed.write_packed(table.limit(0), path, overwrite=True)
    assert packed.read_packed(spark, path).count() == 0 and [f.name for f in (tmp_path / "out").iterdir()] == ["manifest.json"]


def test_a_null_key_is_an_error_and_leaves_nothing(spark, tmp_path):
    table = spark.createDataFrame([(1, [1]), (None, [2])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="doc_id is null"):
        packed.write_packed(table, f"file://{tmp_path}/out")
    assert not list(tmp_path.glob("out/*"))


def test_failed_and_repeated_attempts_leave_no_part(tmp_path):
    batch = pa.RecordBatch.from_arrays([pa.array([4, 5]), pa.array([0, 0]), pa.array([[1, 2], [3]], pa.list_(pa.int32()))], names=["key", "tie", "ids"])

    def broken():
        yield batch
        raise OSError("lost")

    writer = packed.PackedWriter(str(tmp_path), False)
    with pytest.raises(OSError):
        writer.write(broken())
    assert not list(tmp_path.iterdir())
    writer.write(iter([batch]))  # an attempt whose message is never committed
    kept = writer.write(iter([batch, batch]))
    writer.commit([kept, None, writer.write(iter([]))])
    (part,) = json.loads((tmp_path / "manifest.json").read_text())
    assert part["rows"] == 4 and part["tokens"] == 6 and len(list(tmp_path.iterdir())) == 4
    assert packed.PackedFile(str(tmp_path))[3].tolist() == [3]
    again = writer.write(iter([batch]))
    writer.abort([again])
    assert len(list(tmp_path.iterdir())) == 4
