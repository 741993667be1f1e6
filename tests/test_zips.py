"""Zip archives as a source: equal to folders, and only what is asked for is read."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith

from voxmill.sources import zips


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("zips"))
    os.makedirs(f"{root}/a/_hidden")
    for k in range(5):
        at = io.BytesIO()
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED) as z:
            z.writestr("manifest.json", f"manifest {k} " * 200)
            z.writestr("request/", "")
            z.writestr("request/big.bin", os.urandom(50_000))
            z.writestr("request/naïve.txt", "é" * 99)
            z.writestr("nothing", b"")
        with open(f"{root}/a/j{k}.zip", "wb") as f:
            f.write(at.getvalue())
    with open(f"{root}/a/_hidden/x.zip", "wb") as f:
        f.write(b"no archive")
    return root


def members(root):
    for k in range(5):
        with zipfile.ZipFile(f"{root}/a/j{k}.zip") as z:
            yield from ((f"j{k}", x.filename, x.file_size, z.read(x)) for x in z.infolist() if not x.is_dir())


@pytest.mark.parametrize("size", [1, 60_000, 1 << 26])
def test_members(spark, archives, size):
    got = zips.read_zips(spark, archives, partition_bytes=size)
    assert sorted((r.job_id, r.path, r.size, bytes(r.content)) for r in got.collect()) == sorted(members(archives))
    names = zips.read_zips(spark, archives, names=True).collect()
    assert {r.content for r in names} == {None} and len(names) == 20


def test_filters_choose_members(spark, archives):
    reader = zips.PushedZipReader({"path": archives})
    left = list(reader.pushFilters([EqualTo(("path",), "manifest.json"), In(("job_id",), ("j1", "j3")), GreaterThan(("size",), 1)]))
    assert [type(f) for f in left] == [GreaterThan]
    assert [m[1:3] for p in reader.partitions() for m in p.members] == [("j1", "manifest.json"), ("j3", "manifest.json")]
    other = zips.PushedZipReader({"path": archives})
    assert list(other.pushFilters([StringEndsWith(("path",), ".txt")])) == [] and len(other.partitions()[0].members) == 5
    spark.conf.set(zips.PUSH, "true")
    try:
        df = zips.read_zips(spark, archives).where((F.col("path") == "manifest.json") & F.col("job_id").isin("j2", "j4"))
        assert sorted(r.job_id for r in df.collect()) == ["j2", "j4"]
    finally:
        spark.conf.unset(zips.PUSH)
    asked = zips.read_zips(spark, archives, ("nothing", "manifest.json"))
    assert asked.count() == 10 and asked.where("path = 'nothing' and size = 0").count() == 5


def test_damaged_archives(spark, archives, tmp_path):
    with open(f"{archives}/a/j0.zip", "rb") as f:
        raw = bytearray(f.read())
    raw[60] ^= 255
    (tmp_path / "bad.zip").write_bytes(raw)
    with pytest.raises(Exception, match="checksum"):
        zips.read_zips(spark, str(tmp_path)).collect()
