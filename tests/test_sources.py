"""Order of documents over files and splits, and compressed files read frame by frame."""

import gzip
import random
import struct
import zlib

import pytest
import zstandard

from sparktok.operators import batch
from sparktok.sources import files, frames, order

END = "<|endoftext|>"


def rows(df):
    found = sorted((r["doc_id"], r["text"]) for r in df.collect())
    assert [n for n, _ in found] == list(range(len(found)))
    return [t for _, t in found]


@pytest.fixture(scope="module")
def unequal(tmp_path_factory):
    """Files of very different sizes, of which the first in the list is the last by name."""
    folder, rng = tmp_path_factory.mktemp("unequal"), random.Random(3)
    made = []
    for k, n in enumerate((3, 4000, 1, 900, 40, 0, 7)):
        texts = [f"file {k} document {i} " + "x" * rng.randrange(60) for i in range(n)]
        (folder / f"f{9 - k} é.txt").write_text(END.join(texts))
        (folder / f"j{9 - k}.jsonl").write_text("".join(f'{{"text": "{t}"}}\n' for t in texts))
        made.append((9 - k, texts))
    return folder, made


@pytest.mark.parametrize("split", ["4k", "128m"])
def test_documents_are_numbered_in_the_order_of_paths(spark, unequal, split):
    folder, made = unequal
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        want = [t for _, texts in made for t in texts]
        assert rows(files.TextSource([folder / f"f{k} é.txt" for k, _ in made], END).read(spark)) == want
        assert rows(files.JsonlSource([folder / f"j{k}.jsonl" for k, _ in made]).read(spark)) == want
        assert rows(files.TextSource([folder / f"f{k} é.txt" for k, _ in made]).read(spark)) == [END.join(t) for _, t in made if t]
        spark.createDataFrame([(t,) for t in want], "text string").repartition(5).write.mode("overwrite").parquet(str(folder / f"p{split}"))
        found = rows(files.ParquetSource(folder / f"p{split}").read(spark))
        assert sorted(found) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_globs_folders_and_paths_given_twice(spark, unequal, monkeypatch):
    folder, made = unequal
    by_name = [t for _, texts in sorted(made) for t in texts]
    assert rows(files.TextSource(folder / "f*.txt", END).read(spark)) == by_name
    first, last = (folder / "f9 é.txt", made[0][1]), (folder / "f3 é.txt", made[6][1])
    assert rows(files.TextSource([last[0], first[0], last[0]], END).read(spark)) == last[1] + first[1] + last[1]
    monkeypatch.setattr(order, "MOST_SPLITS", 2)  # as for very many splits: summed and joined by Spark
    assert rows(files.TextSource([folder / f"f{k} é.txt" for k, _ in made], END).read(spark)) == [t for _, texts in made for t in texts]


def test_packed_ids_are_in_the_order_of_files(spark, unequal):
    from sparktok.queries import small_model

    folder, made = unequal
    paths = [str(folder / f"f{k} é.txt") for k, _ in made]
    model = small_model()
    packed = batch.encode_files(spark, files.TextSource(paths, END), model, packed=True)
    want = batch.encode_batch(spark, [t for _, texts in made for t in texts], model).orderBy("doc_id").collect()
    assert packed.to_list() == [list(r["ids"]) for r in want]


def blocked(part):
    """A member of a blocked gzip file."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(part) + packer.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(part), len(part))


def test_frames_cut_documents_anywhere(tmp_path):
    rng = random.Random(0)
    for trial in range(80):
        separator = rng.choice([b"\n", b"<|endoftext|>", b"ab"])
        data = b"".join(rng.choice([separator, b"x", b"some words ", b"a", b"<|end", "é".encode()]) for _ in range(rng.randrange(400)))
        cuts = sorted(rng.randrange(len(data) + 1) for _ in range(rng.randrange(30)))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        zst = b"".join(zstandard.ZstdCompressor(write_checksum=rng.random() < 0.5, write_content_size=rng.random() < 0.5).compress(p) for p in parts)
        skippable = struct.pack("<II", 0x184D2A50, 3) + b"abc"
        for name, packed in (("a.zst", skippable * (trial % 3) + zst), ("b.gz", b"".join(map(blocked, parts))), ("c.gz", b"".join(map(gzip.compress, parts)))):
            path = tmp_path / f"{trial}{name}"
            path.write_bytes(packed)
            runs = frames.runs(str(path), True, rng.choice([1, 40, 200]))
            assert [d for r in runs for d in frames.documents(r, separator)] == [d for d in data.split(separator) if d]
            assert b"".join(frames.documents(frames.runs(str(path), False)[0], b"")) == data
            assert len(runs) == 1 or name != "c.gz"


def test_frame_files_as_a_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(frames, "PARTITION_BYTES", 400)
    rng = random.Random(1)
    texts = [f"document {k} " + "".join(rng.choices("abcdef é\n", k=rng.randrange(200))) for k in range(500)]
    data = END.join(texts).encode()
    parts = [data[a : a + 700] for a in range(0, len(data), 700)]
    (tmp_path / "a é.txt.zst").write_bytes(b"".join(zstandard.ZstdCompressor().compress(p) for p in parts))
    (tmp_path / "b.txt.gz").write_bytes(b"".join(map(blocked, parts)))
    (tmp_path / "c.txt").write_bytes(data)
    for names in (["a é.txt.zst"], ["b.txt.gz"], ["c.txt", "a é.txt.zst", "b.txt.gz"]):
        assert rows(files.TextSource([tmp_path / n for n in names], END).read(spark)) == texts * len(names)
    assert rows(files.TextSource(tmp_path / "a é.txt.zst").read(spark)) == [data.decode()]
    assert len(frames.runs(str(tmp_path / "a é.txt.zst"), True, 400)) > 20 and len(frames.runs(str(tmp_path / "a é.txt.zst"), frames._overlaps_itself(b"ab"), 400)) == 1
    (tmp_path / "broken.txt.zst").write_bytes((tmp_path / "a é.txt.zst").read_bytes()[:-5])
    (tmp_path / "broken.txt.gz").write_bytes(gzip.compress(data)[:-20])
    for name in ("broken.txt.zst", "broken.txt.gz"):
        with pytest.raises(Exception, match="cut off"):
            files.TextSource(tmp_path / name, END).read(spark, ordered=False).collect()
