"""Containers are listed as streams: the same members, in little memory."""

import bz2
import gzip
import io
import lzma
import os
import subprocess
import sys
import tarfile
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from corpuloom.sources import archives, files, tree

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def tar_bytes(names=("a.txt", "d/", "d/é.txt", "x" * 150 + "/long.txt")):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for i, n in enumerate(names):
            info = tarfile.TarInfo(n.rstrip("/"))
            info.type = tarfile.DIRTYPE if n.endswith("/") else tarfile.REGTYPE
            info.size = 0 if n.endswith("/") else 100 * i
            t.addfile(info, io.BytesIO(b"y" * info.size))
    return out.getvalue()


def zip_bytes(names=("a.txt", "d/", "d/é.txt", "c"), note=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, n in enumerate(names):
            z.writestr(n, "" if n.endswith("/") else "z" * 50 * i)
        z.comment = note
    return out.getvalue()


MADE = {
    "plain.zip": zip_bytes(), "noted.zip": zip_bytes(note=b"PK\x01\x02 not an entry"), "empty.zip": zip_bytes(()), "grown.exe.zip": zip_bytes(), "plain.tar": tar_bytes(), "a.tgz": gzip.compress(tar_bytes()), "a.tar.bz2": bz2.compress(tar_bytes()),
    "a.tar.xz": lzma.compress(tar_bytes()), "one.txt.gz": gzip.compress(b"hello" * 9), "two.gz": gzip.compress(b"ab") + gzip.compress(b"cde"), "b.bz2": bz2.compress(b"q" * 5000), "c.xz": lzma.compress(b"r" * 700), "text.txt": b"no container", "nothing": b"",
}


@pytest.mark.parametrize("name", sorted(MADE))
def test_streams_list_what_whole_containers_do(tmp_path, name):
    at = tmp_path / name
    at.write_bytes(MADE[name])
    assert list(archives.members(os.fsencode(at))) == files.members_of(name, MADE[name])
    assert list(archives.members(os.fsencode(at), 2)) == files.members_of(name, MADE[name])[:2]


def test_zstd_and_prefixes_and_many_members(tmp_path):
    packed = tmp_path / "a.tar.zst"
    packed.write_bytes(zstandard.compress(tar_bytes()))
    assert [m[0] for m in archives.members(os.fsencode(packed))] == ["a.txt", "d", "d/é.txt", "x" * 150 + "/long.txt"]
    shifted = tmp_path / "self-extracting"
    shifted.write_bytes(b"PK\x03\x04" + b"#!stub" * 40 + zip_bytes())
    assert [m[0] for m in archives.members(os.fsencode(shifted))] == ["a.txt", "d/", "d/é.txt", "c"]
    many = tmp_path / "many.zip"
    with zipfile.ZipFile(many, "w") as z:
        for i in range(70_000):  # beyond what the short record at the end can count
            z.writestr(f"f{i}", "")
    assert [m[0] for m in archives.members(os.fsencode(many), 10**9)] == [f"f{i}" for i in range(70_000)]


def test_listing_a_tree_of_containers(spark, tmp_path):
    for name, data in MADE.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "cut.tgz").write_bytes(MADE["a.tgz"][:90])
    (tmp_path / "cut.zip").write_bytes(MADE["plain.zip"][:-30])
    (tmp_path / "folder").mkdir()
    tree.register(spark)
    got = archives.listed(spark.read.format("filetree").load(str(tmp_path)), str(tmp_path)).withColumn("name", F.decode("container", "utf-8")).collect()
    want = {(n, *m) for n, data in MADE.items() for m in files.members_of(n, data)}
    assert {(r["name"], r["member"], r["size"], r["kind"]) for r in got if not r["name"].startswith("cut")} == want
    assert {r["name"] for r in got if r["note"]} == {"cut.zip", "cut.tgz"} and all(r["note"].startswith("damaged") for r in got if r["note"])
    outside = spark.createDataFrame([(bytearray(b"../x"), "file")], "raw binary, kind string")
    assert [r["note"] for r in archives.listed(outside, str(tmp_path)).collect()] == ["damaged: ValueError"]


def test_a_container_larger_than_memory_is_listed(tmp_path):
    """Three gigabytes of tar, sparse on the disk, and 300 MB in a gzip, listed by a process that may hold 200 MB more than it starts with."""
    big = tmp_path / "big.tar"
    with open(big, "wb") as f:
        for i in range(3):
            info = tarfile.TarInfo(f"part{i}")
            info.size = 1 << 30
            f.write(info.tobuf())
            f.seek(info.size, os.SEEK_CUR)
        f.write(b"\0" * 1024)
    packed = tmp_path / "big.tgz"
    with gzip.open(packed, "wb", compresslevel=1) as f:
        info = tarfile.TarInfo("zeros")
        info.size = 300 << 20
        f.write(info.tobuf())
        for _ in range(300):
            f.write(b"\0" * (1 << 20))
        f.write(tarfile.TarInfo("last").tobuf() + b"\0" * 1024)
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
import resource
from corpuloom.sources import archives
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print([m[0] for n in ({os.fsencode(big)!r}, {os.fsencode(packed)!r}) for m in archives.members(n)], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert said.startswith("['part0', 'part1', 'part2', 'zeros', 'last']")
    assert int(said.rsplit(" ", 1)[1]) < 200
