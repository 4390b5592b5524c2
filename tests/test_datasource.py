import os
import time
import zipfile

import pytest

from sievetext.sources import bundle, datasource
from sievetext.streaming.trim import write_stream

from .test_bundle import MEMBERS, WANT, contents


def rows_of(df):
    return contents(datasource.bundle_rows(df).selectExpr("*", "0L as part_no"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    datasource.register_bundle_source(spark)
    root = tmp_path_factory.mktemp("source")
    for name, data in MEMBERS.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
    with zipfile.ZipFile(root / "more.ZIP", "w") as archive:
        archive.writestr("in/e.txt", "from a zip")
        archive.writestr("__MACOSX/e.txt", "no")
    with zipfile.ZipFile(root / "plainname", "w") as archive:
        archive.writestr("f.csv", "h\nfrom a file without a name")
    (root / "README").write_text("no archive at all, and no extension")
    (root / "_hidden.txt").write_text("no")
    return str(root)


def test_format_equals_read_bundle(spark, folder):
    want = contents(bundle.read_bundle(spark, folder))
    assert want == WANT | {"in/e.txt": ["from a zip"], "f.csv": ["from a file without a name"]}
    pieces = spark.read.format(datasource.FORMAT).load(folder)
    assert rows_of(pieces) == want
    assert rows_of(spark.read.format(datasource.FORMAT).load(f"file://{folder}")) == want
    errors = {(r.filename, r.error) for r in bundle.bundle_errors(spark, folder).collect()}
    assert {tuple(r) for r in datasource.bundle_problems(pieces).collect()} == errors and ("README", bundle.NOT_READABLE) in errors
    one = spark.read.format(datasource.FORMAT).load(f"{folder}/more.ZIP")
    assert rows_of(one) == {"in/e.txt": ["from a zip"]}
    with pytest.raises(Exception, match="nothing-there"):
        spark.read.format(datasource.FORMAT).load(f"{folder}/nothing-there").collect()


def test_members_are_packed_in_order():
    members = [datasource.Member("p", str(i), i, size) for i, size in enumerate([1, 9 << 20, 1, 2, -1, *[1] * 300])]
    parts = datasource.packed(members)
    assert [m for part in parts for m in part.members] == members
    assert [len(part.members) for part in parts] == [1, 1, 256, 47] and datasource.packed([]) == []


def test_arriving_archives_are_read_once(spark, tmp_path, folder):
    source, run = tmp_path / "in", tmp_path / "run"
    source.mkdir()

    def arrive(name, text, age):
        with zipfile.ZipFile(source / name, "w") as archive:
            archive.writestr(f"{name}.txt", text)
        at = time.time() - age
        os.utime(source / name, (at, at))

    def advance():
        stream = spark.readStream.format(datasource.FORMAT).load(str(source))
        write_stream(datasource.bundle_rows(stream), str(run / "rows"), str(run / "state")).awaitTermination()
        return sorted(r.content for r in spark.read.parquet(str(run / "rows")).collect())

    arrive("a.zip", "first", 100)
    arrive("b.zip", "second", 90)
    assert advance() == ["first", "second"]
    arrive("c.zip", "third", 50)
    arrive("d.zip", "not settled yet", -60)
    assert advance() == ["first", "second", "third"]
    assert advance() == ["first", "second", "third"]
