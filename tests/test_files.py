"""Byte ranges of files: what is read, files beyond 2 GiB, user readers, folders without files."""

import hashlib

import pytest

from cutloom.sources import files as FS


def test_ranges_of_a_file_beyond_two_gib(spark, tmp_path):
    size = 3 << 30
    with open(tmp_path / "big.bin", "wb") as f:  # takes no disk: all but the ends is a hole
        f.write(b"head")
        f.seek(size - 4)
        f.write(b"tail")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "small.ogg").write_bytes(b"abc")
    (tmp_path / "deep" / "none").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"x")
    got = {r.name: r for r in FS.file_ranges(spark, str(tmp_path), head=4, tail=6).collect()}
    assert set(got) == {"big.bin", "small.ogg", "none"}
    big = got["big.bin"]
    assert (big.length, bytes(big.head), bytes(big.tail)) == (size, b"head", b"\0\0tail")
    assert bytes(got["small.ogg"].head) == b"abc" == bytes(got["small.ogg"].tail) and bytes(got["none"].head) == b""
    prints = {r.name: r.fingerprint for r in FS.fingerprint_files(spark, str(tmp_path), "v", 6).collect()}
    assert prints["big.bin"] == hashlib.sha256(f"{size}:v:".encode() + b"head\0\0" + b"\0\0tail").hexdigest()
    assert {r.name: r.container for r in FS.classify_files(spark, "file:" + str(tmp_path)).collect()}["small.ogg"] == "ogg"


def test_files_are_dealt_out_by_what_is_read(tmp_path, monkeypatch):
    for k in range(10):
        (tmp_path / f"{k}").write_bytes(b"x" * 100)
    monkeypatch.setattr(FS, "PART_BYTES", 250)
    assert [len(p.files) for p in FS.RangeReader(str(tmp_path), 100, 0).partitions()] == [2] * 5
    assert [len(p.files) for p in FS.RangeReader(str(tmp_path), 10, 10).partitions()] == [10]
    assert [len(p.files) for p in FS.RangeReader(str(tmp_path / "3"), 10, 10).partitions()] == [1]


def test_user_readers(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.txt").write_bytes(b"0123456789" * (k + 1))

    def every_tenth(source):
        for at in range(0, source.size, 10):
            yield at, source.read(at, 2).decode()

    rows = FS.demux_files(spark, str(tmp_path), every_tenth, "at int, text string", batch_rows=2).collect()
    assert len(rows) == 15 and {r.text for r in rows} == {"01"} and {(r["at"], r.bytes_read) for r in rows} == {(10 * k, 2 * k + 2) for k in range(5)}

    def too_far(source):
        source.read(0, source.size + 1)
        yield (1,)

    with pytest.raises(Exception, match="reader failed on .*txt"):
        FS.demux_files(spark, str(tmp_path), too_far, "n int").collect()


def test_a_folder_without_files(spark, tmp_path):
    assert FS.file_ranges(spark, str(tmp_path), 4, 4).count() == 0
    assert FS.demux_files(spark, str(tmp_path), lambda s: [], "n int").count() == 0
