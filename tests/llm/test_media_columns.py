import zipfile

import numpy as np
from pyarrow import fs

from depframe.llm.media_columns import ArchiveReader, from_png, media_columns, padded, read_archives, to_png, write_archives

TEXTS = [None, "", "a", "x" * 64, "y" * 65, "é漢\0", "z" * 20000, "a"]


def test_round_trip(spark):
    df = spark.createDataFrame([(i if i != 3 else None, t, b"") for i, t in enumerate(TEXTS)], "doc_id long, text string, media binary").repartition(3)
    out = media_columns(df).collect()
    assert len(out) == len(TEXTS) and not any(r["error"] for r in out)
    for r in out:
        data = (TEXTS[3 if r["key"] is None else r["key"]] or "").encode()
        assert r["n_bytes"] == len(data) and bytes(r["payload"]) == padded(data) and len(r["payload"]) % 64 == 0 < len(r["payload"])
        assert from_png(bytes(r["media"])).tobytes() == padded(data)
    same = [r for r in out if r["key"] in (2, 7)]
    assert same[0]["media"] == same[1]["media"] and same[0]["feature"] == same[1]["feature"]
    assert media_columns(df.limit(0)).count() == 0


def test_ranges_cover_each_member_once(spark):
    df = spark.range(300).selectExpr("id doc_id", "repeat(cast(id as string), 50) text").repartition(2)
    folder = write_archives(df)
    got = [r["key"] for r in read_archives(spark, folder, range_bytes=777).select("key").collect()]
    assert sorted(got) == list(range(300))


def test_a_damaged_member_fails_alone(spark, monkeypatch):
    folder = write_archives(spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string").coalesce(1))
    store, path = fs.FileSystem.from_uri(folder)
    name = next(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".zip"))
    with zipfile.ZipFile(name) as z:
        at = z.infolist()[2].header_offset
    data = bytearray(open(name, "rb").read())
    data[at + 60] ^= 255
    open(name, "wb").write(data)
    rows = read_archives(spark, folder).collect()
    assert sorted(r["key"] for r in rows) == list(range(5))
    assert [r["key"] for r in rows if r["error"]] == [2]
    # A passing fault is mended by reading that member again.
    reader, tries, whole = ArchiveReader({"path": folder}), [], zipfile.ZipFile.read

    def flaky(self, info, *a):
        tries.append(info.header_offset)
        if tries.count(info.header_offset) == 1:
            raise OSError("lost")
        return whole(self, info, *a)

    monkeypatch.setattr(zipfile.ZipFile, "read", flaky)
    read = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert sum(x["error"] is None for x in read) == 4 and all(tries.count(t) >= 2 for t in tries)


def test_samples():
    assert (from_png(to_png(bytes(range(64)) * 3)) == np.arange(64)).all()


def test_empty_partitions(spark):
    df = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    assert [r["key"] for r in media_columns(df.repartition(4)).collect()] == [1]
    assert media_columns(df.where("doc_id > 5")).collect() == []


def test_an_unreadable_archive_gives_one_row(spark, tmp_path):
    (tmp_path / "part-000000.zip").write_bytes(b"no archive " * 50)
    (row,) = read_archives(spark, f"file://{tmp_path}", range_bytes=100).collect()
    assert row["error"] and row["payload"] is None
