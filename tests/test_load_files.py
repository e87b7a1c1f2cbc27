"""Typed loads, directory snapshots and late file contents."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.sources import files as FI
from quarry.sources import load as L

ITEM = L.Table("item", (L.Column("id", "bigint", True), L.Column("day", "date"), L.Column("price", "decimal(10,2)", True),
                        L.Column("gone", "boolean", default="false"), L.Column("note", "string", default="'none'")))


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_defaults_apply_to_missing_fields_alone(spark, tmp_path):
    db = "load_defaults"
    L.create_or_replace(spark, ITEM, db)
    L.copy_into(spark, ITEM, write(tmp_path, "a.csv", ["1,2020-01-02,3.50,true,x", '2,NULL,4,null,"a, b"']), database=db)
    got = L.copy_into(spark, ITEM, write(tmp_path, "b.csv", ["3, 1.25"]), ("id", "price"), database=db)
    rows = {r.id: (str(r.day), str(r.price), r.gone, r.note) for r in got.collect()}
    assert rows == {1: ("2020-01-02", "3.50", True, "x"), 2: ("None", "4.00", None, "a, b"), 3: ("None", "1.25", False, "none")}


@pytest.mark.parametrize("bad", ["x,2020-01-01,1,true,a", ",2020-01-01,1,true,a", "5,2020-13-01,1,true,a",
                                 "5,2020-01-01,none,true,a", "5,2020-01-01,1"])
def test_a_failing_load_leaves_the_table(spark, tmp_path, bad):
    db = "load_failing"
    L.create_or_replace(spark, ITEM, db)
    L.copy_into(spark, ITEM, write(tmp_path, "a.csv", ["1,2020-01-02,3.50,true,x"]), database=db)
    with pytest.raises(Exception):
        L.copy_into(spark, ITEM, write(tmp_path, "b.csv", ["4,2020-01-02,3.50,true,x", bad]), database=db)
    assert [r.id for r in spark.table(f"{db}.item").collect()] == [1]
    assert [t.name for t in spark.catalog.listTables(db)] == ["item"]              # no staged table stays


def test_replace_keeps_readers_of_the_old_rows(spark, tmp_path):
    db = "load_replace"
    L.create_or_replace(spark, ITEM, db)
    first = write(tmp_path, "a.csv", ["1,2020-01-02,3.50,true,x"])
    old = L.copy_into(spark, ITEM, first, database=db)
    files = old.inputFiles()
    new = L.copy_into(spark, ITEM, write(tmp_path, "b.csv", ["2,2020-01-02,3.50,true,x"]), replace=True, database=db)
    assert [r.id for r in new.collect()] == [2]
    assert [r.id for r in spark.read.parquet(*files).collect()] == [1]
    L.create_or_replace(spark, ITEM, db)
    assert spark.table(f"{db}.item").count() == 0


def test_gzip_without_header_and_quoted_lines(spark, tmp_path):
    from quarry.sources.csv import write_csv
    rows = spark.createDataFrame([("1", "2021-05-06", "3", "bike", 'said "no", then\nleft')], "a string, b string, c string, d string, e string")
    write_csv(rows, str(tmp_path / "c"), header=False)
    L.create_or_replace(spark, L.COMMENTS, "load_comments_test")
    got = L.copy_into(spark, L.COMMENTS, str(tmp_path / "c"), database="load_comments_test").collect()
    assert [(r.comment_id, str(r.comment_date), r.comment_text) for r in got] == [(1, "2021-05-06", 'said "no", then\nleft')]


def test_snapshots_compare_by_relative_path(spark, tmp_path):
    top = tmp_path / "stage"
    for folder in ("bike", "snow"):
        (top / folder).mkdir(parents=True)
        (top / folder / "guide.pdf").write_text(folder)
    (top / "note.txt").write_text("n")
    listed = {r.relative_path: (r.stage_name, r.file_name, r.size_bytes) for r in FI.listing(spark, str(top)).collect()}
    assert listed == {"bike/guide.pdf": ("bike", "guide.pdf", 4), "snow/guide.pdf": ("snow", "guide.pdf", 4), "note.txt": ("", "note.txt", 1)}
    before = FI.snapshot(spark, str(top), str(tmp_path / "s1"))
    (top / "snow" / "guide.pdf").write_text("more snow")
    os.utime(top / "note.txt", (1, 1))
    (top / "bike" / "guide.pdf").rename(top / "bike" / "other.pdf")
    after = FI.snapshot(spark, f"file://{top}", str(tmp_path / "s2"))
    got = {r.relative_path: r.status for r in FI.changes(before, after).collect()}
    assert got == {"bike/guide.pdf": "removed", "bike/other.pdf": "added", "snow/guide.pdf": "changed", "note.txt": "changed"}
    assert {r.status for r in FI.changes(after, after).collect()} == {"same"}
    expected = spark.createDataFrame([("bike", 1), ("snow", 2), ("csv", 1)], "stage_name string, expected bigint")
    counts = {r.stage_name: (r.files, r.expected, r.complete) for r in FI.stage_counts(after, expected).collect()}
    assert counts == {"bike": (1, 1, True), "snow": (1, 2, False), "csv": (0, 1, False), "": (1, 0, False)}


def test_late_contents_are_read_by_tasks(spark, tmp_path, monkeypatch):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(40):
        (src / f"f {i}.bin").write_bytes(bytes([i]) * (i * 100))
    monkeypatch.setattr(FI, "READ_BYTES", 10_000)
    wanted = spark.createDataFrame([(f"f {i}.bin",) for i in range(2, 40, 2)] + [("gone.bin",)], "file_name string")
    found = FI.read_contents(spark, str(src), wanted)
    assert found.rdd.getNumPartitions() > 1
    got = {r.file_name: bytes(r.content) for r in found.collect()}
    assert got == {f"f {i}.bin": bytes([i]) * (i * 100) for i in range(2, 40, 2)}


def test_uri_of_listed_paths():
    assert FI.uri("file:/a b/c") == "file:///a%20b/c"
    assert FI.uri("file:///a/c") == "file:///a/c"
    assert FI.uri("hdfs://host:8020/x y") == "hdfs://host:8020/x%20y"
    assert FI.uri("s3a://bucket/k") == "s3a://bucket/k"


def test_large_files_come_in_blocks(spark, tmp_path, monkeypatch):
    import gzip
    import hashlib
    src = tmp_path / "src"
    src.mkdir()
    held = {"a.bin": os.urandom(10_500), "b.bin": os.urandom(3_000), "c.bin": b"x", "d.gz": gzip.compress(b"plain" * 999)}
    for name, content in held.items():
        (src / name).write_bytes(content)
    monkeypatch.setattr(FI, "BLOCK_BYTES", 1_000)
    wanted = spark.createDataFrame([(n,) for n in held], "file_name string")
    found = FI.read_contents(spark, str(src), wanted)
    rows = found.collect()
    assert max(len(r.content) for r in rows) <= 1_000
    for name, content in held.items():
        assert b"".join(bytes(r.content) for r in sorted(rows, key=lambda r: r.block) if r.file_name == name) == content
    got = {r.file_name: r.content_sha256 for r in FI.content_digests(found).collect()}
    assert got == {name: hashlib.sha256(content).hexdigest() for name, content in held.items()}


def test_stage_folders_are_written_by_several_tasks(spark, monkeypatch):
    """Each source's file is the work of one task, and no task has all of them."""
    from conftest import SF_SMALL
    seen, frame = [], type(spark.range(1))
    write = frame.write
    monkeypatch.setattr(frame, "write", property(lambda self: (seen.append(self) if "source" in self.columns else None, write.fget(self))[1]))
    FI.directory_changes(spark, SF_SMALL).collect()
    plans = [d._jdf.queryExecution().toString() for d in seen]
    assert plans and all("REPARTITION_BY_COL" in p and "Coalesce" not in p for p in plans)
