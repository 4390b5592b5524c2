import csv
import io
import json
import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievetext.sources import bundle as S
from sievetext.sources import csv_splits, json_items
from sievetext.sources.extract import extract_csv_longest, extract_json, longest_csv_values

MEMBERS = {
    "a.txt": b"l1\r\n\r\n  l2, x  \nbad\xff\n",
    "sub/b.csv": b'h1,h2\r\nx,"long, text\nmore"\r\ny\r\nz,w,extra\r\n',
    "tie.csv": b"h1,h2\nab,cd\nef,gh\n",
    "quote.csv": b'h\n"say ""hi"""\n',
    "empty_cell.csv": b"h1,h2\nx,long\ny,\n",
    "header.csv": b"only,header\n",
    "none.csv": b"",
    "c.json": b'[{"k":"v","t":"hello there"},{"t":"second"},{"k":1}]',
    "d.json": b'{"a":"x","b":"longest value"}',
    "list.json": b'["a","b"]',
    "bad.json": b"{bad",
    "upper.TXT": b"no",
    "x.md": b"no",
    "__MACOSX/._a.txt": b"no",
    "bom.txt": b"\xef\xbb\xbffirst\nsecond",
    "name with space+plus%.txt": b"odd name",
    "lines.txt": "a\x0bb\x0cc\x1cd e\x85f".encode(),
}
WANT = {
    "a.txt": ["l1", "l2 x", "bad�"],
    "sub/b.csv": ["long text more", "w"],
    "tie.csv": ["ab", "ef"],
    "quote.csv": ['say "hi"'],
    "empty_cell.csv": ["long", ""],
    "c.json": ["hello there", "second"],
    "d.json": ["longest value"],
    "bom.txt": ["first", "second"],
    "name with space+plus%.txt": ["odd name"],
    "lines.txt": ["a", "b", "c", "d", "e", "f"],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("bundle")
    for name, data in MEMBERS.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(root)


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    path = tmp_path_factory.mktemp("zips") / "in.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        out.mkdir("empty_folder")
        for name, data in MEMBERS.items():
            out.writestr(name, data)
    return str(path)


def contents(df):
    result = {}
    for row in df.orderBy("filename", "block", "row_no", "part_no").collect():
        result.setdefault(row.filename, []).append(row.content)
    return result


def test_zip(spark, archive):
    assert contents(S.read_bundle(spark, archive, tasks=3)) == WANT


def test_folder(spark, folder):
    assert contents(S.read_bundle(spark, folder, tasks=3)) == WANT


def test_folder_with_uri(spark, folder):
    assert contents(S.read_bundle(spark, f"file://{folder}", tasks=1)) == WANT


def test_scan_keeps_archive_order_and_reads_no_content(spark, archive):
    members = S.scan_bundle(spark, archive).orderBy("member_no").collect()
    wanted = [n for n in MEMBERS if n.rsplit(".", 1)[1] in ("txt", "csv", "json") and not n.startswith("__MACOSX")]
    assert [m.filename for m in members] == wanted
    assert [m.size for m in members] == [len(MEMBERS[n]) for n in wanted]


def test_many_archives(spark, tmp_path):
    for i in range(5):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as out:
            for j in range(4):
                out.writestr(f"{i}-{j}.txt", f"line {i} {j}\n" * 50)
    rows = S.read_bundle(spark, str(tmp_path), tasks=4)
    assert rows.count() == 1000 and rows.select("filename").distinct().count() == 20


def test_split_text_file_keeps_every_line(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50 + 1) for i in range(20_000)]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = S.read_bundle(spark, str(tmp_path))
        assert rows.select("block").distinct().count() > 3
        assert contents(rows) == {"big.txt": lines}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_blocks(monkeypatch):
    data = b"one\ntwo two\n\nthree" + b"y" * 50 + b"\nend"
    for size in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(S, "BLOCK_BYTES", size)
        blocks = list(S._line_blocks(io.BytesIO(data)))
        assert b"".join(blocks) == data
        assert all(b.endswith(b"\n") for b in blocks[:-1])


def test_large_members(spark, tmp_path):
    """Members above the block size, and a CSV field above the module's default limit."""
    text = "\n".join(f"row {i}" for i in range(900_000))
    big = "z" * 300_000
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("t.txt", text)
        out.writestr("c.csv", "a,b\n1," + big + "\n" + "".join(f"{i},v{i}\n" for i in range(20_000)))
    rows = S.read_bundle(spark, str(tmp_path / "big.zip"), tasks=2)
    counts = {r.filename: r["count"] for r in rows.groupBy("filename").count().collect()}
    assert counts == {"t.txt": 900_000, "c.csv": 20_001}
    ordered = rows.filter("filename = 't.txt'").orderBy("block", "row_no").select("content").limit(3).collect()
    assert [r.content for r in ordered] == ["row 0", "row 1", "row 2"]
    assert rows.filter(F.length("content") == 300_000).count() == 1


def test_errors_are_reported(spark, tmp_path):
    (tmp_path / "blank.csv").write_bytes(b"h\n\nx\n")
    (tmp_path / "fine.csv").write_bytes(b"h\nx\n")
    assert contents(S.read_bundle(spark, str(tmp_path), tasks=1)) == {"fine.csv": ["x"]}
    assert [(r.filename, r.error) for r in S.bundle_errors(spark, str(tmp_path), tasks=1).collect()] == [
        ("blank.csv", "the first data row is blank")
    ]


JSON_CASES = {
    '[{"k":"v","t":"hello there"},{"t":"second"},{"k":1}]': ["hello there", "second"],
    '{"a":"xx","b":"yy"}': ["xx"],
    '[{"a":"x"},"str",3,{"a":"y"},null,{"a":null}]': ["x", "y"],
    '["str",{"a":"x"}]': [],
    '[{"a":"1","a":"22"}]': ["22"],
    '[{"a":"long value","b":"yy","a":"x"},{"b":"z"}]': ["yy", "z"],
    '{"a":"long value","b":"yy","a":"x"}': ["yy"],
    '[{"a":"b"}] trailing': [],
    '{"a":"b"} x': [],
    '{"a":"b"}]': [],
    '[{"a":"b"}]]': [],
    '[{"a":"b"}],': [],
    '{"a":"b"},': [],
    '{"a":"b"}],[{}': [],
    '[{"a":"b"}],[{"a":"c"}]': [],
    "{'a':'b'}": [],
    "[]": [],
    "{}": [],
    "[{}]": [],
    '{"a":null}': [],
    "3": [],
    '"s"': [],
    "": [],
    ' \n[ {"a":"b"} ] ': ["b"],
    '﻿{"a":"b"}': [],
    '[[{"a":"b"}]]': [],
    '[{"a":"x\\u00e9\\ny"}]': ["xé y"],
    '[{"n":12,"b":"abc"},{"n":5}]': ["abc"],
    '[{"n":1234,"b":"abc"},{"n":5}]': ["1234", "5"],
    '[{"a":{"b":[1,2]},"c":"d"}]': ['{"b":[1 2]}'],
}


def test_json_cases(spark):
    files = spark.createDataFrame(list(enumerate(JSON_CASES)), "filename string, content string")
    got = {}
    for row in extract_json(files).orderBy("row_no").collect():
        got.setdefault(int(row.filename), []).append(row.content)
    for i, (text, want) in enumerate(JSON_CASES.items()):
        assert got.get(i, []) == want, text


def test_json_equals_python_on_string_objects(spark):
    import random

    rng = random.Random(4)
    docs = []
    for _ in range(200):
        keys = rng.sample("abcdef", rng.randrange(1, 5))
        docs.append([{k: "v" * rng.randrange(0, 6) + k for k in rng.sample(keys, rng.randrange(1, len(keys) + 1))} for _ in range(4)])
    files = spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(docs)], "filename string, content string")
    got = {}
    for row in extract_json(files).orderBy("row_no").collect():
        got.setdefault(int(row.filename), []).append(row.content)
    for i, objects in enumerate(docs):
        key = max(objects[0], key=lambda k: len(objects[0][k]))
        assert got[i] == [o[key] for o in objects if key in o]


def test_csv_of_content_column(spark):
    rows = [(n, d.decode("utf-8", "replace")) for n, d in MEMBERS.items() if n.endswith(".csv")]
    files = spark.createDataFrame([*rows, ("null.csv", None), ("blank.csv", "h\n\nx\n")], "filename string, content string")
    got = {}
    for row in extract_csv_longest(files).orderBy("row_no").collect():
        got.setdefault(row.filename, []).append(row.content)
    assert got == {n: w for n, w in WANT.items() if n.endswith(".csv")}


def test_line_blocks_cut_at_any_break(monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 5)
    for data in (b"ab\rcd\r\nef\ngh", b"abcdefghijk", b"a\r\nb\r\nc\r", b"abcd\r\nx", b""):
        blocks = list(S._line_blocks(io.BytesIO(data)))
        assert b"".join(blocks) == data
        assert [x for b in blocks for x in b.splitlines()] == data.splitlines()


def test_errors_and_upper_case_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "B.ZIP", "w") as archive:
        archive.writestr("a.txt", "one line")
        archive.writestr("bad.json", "{not json")
        archive.writestr("none.json", "[{}]")
        archive.writestr("good.json", '{"k": "value"}')
    assert {r.content for r in S.read_bundle(spark, str(tmp_path)).collect()} == {"one line", "value"}
    assert {r.filename for r in S.bundle_errors(spark, str(tmp_path)).collect()} == {"bad.json", "none.json"}


def test_a_broken_csv_keeps_its_first_rows(spark):
    files = spark.createDataFrame([("a.csv", "h,k\nx,long\ny,more\nz\r,q\n")], "filename string, content string")
    assert [r.content for r in extract_csv_longest(files).orderBy("row_no").collect()] == ["long", "more"]


def read_whole(data: bytes):
    values = []
    try:
        for value in longest_csv_values(io.TextIOWrapper(io.BytesIO(data), encoding="utf-8", errors="replace", newline="\n")):
            values.append(value)
    except csv.Error:
        return values, True
    return values, False


def read_in_splits(data: bytes, size: int):
    scans = []
    for n, first in enumerate(range(0, len(data), size)):
        stream, last = io.BytesIO(data), min(len(data), first + size)
        ends, boundaries = csv_splits.scan_split(csv_splits._blocks(stream, first, last))
        field, problem = csv_splits.longest_field_of(csv_splits._Lines(stream, 0)) if n == 0 else (None, None)
        boundaries = [None if b is None else first + b for b in boundaries]
        scans.append(("p", "f", n, first, last, ends, boundaries, field, problem))
    if not scans:
        return [], False
    columns = ["path", "filename", "split_no", "first", "last", "ends", "boundaries", "field", "problem"]
    values = []
    for row in csv_splits._chained(pd.DataFrame(scans, columns=columns)).to_dict("records"):
        if not pd.isna(row["problem"]):
            return [], True
        try:
            for _, value in csv_splits.split_values(row, io.BytesIO(data)):
                values.append(value)
        except csv.Error:
            return values, True
    return values, False


def test_csv_splits_equal_the_whole_file(monkeypatch):
    rng = random.Random(6)
    marks = ["a", "b", '"', '"', '""', ",", "\n", "\r\n", '"\n', '\n"', "xx", "é", "q"]
    for _ in range(4000):
        data = "".join("\r" if rng.random() < 0.01 else rng.choice(marks) for _ in range(rng.randint(0, 40))).encode()
        data = data.replace(b"q", b"\xff") if rng.random() < 0.1 else data
        monkeypatch.setattr(csv_splits, "READ_BYTES", rng.choice([1, 3, 100]))
        size = rng.choice([1, 2, 3, 5, 9, 30])
        assert read_in_splits(data, size) == read_whole(data), (data, size)


def test_a_plain_csv_is_read_by_many_tasks(spark, tmp_path):
    lines = ["n,body", *(f"{i},plain line number {i}" for i in range(4000))]
    (tmp_path / "plain.csv").write_text("\n".join(lines))
    quoted = "n,body\r\n" + "".join(f'{i},"line {i}\nwith ""quotes"", and\n\nbreaks"\r\n' for i in range(4000))
    (tmp_path / "quoted.csv").write_text(quoted)
    (tmp_path / "stops.csv").write_text("h,k\n" + "x,long\n" * 3000 + "z\r,q\n" + "y,never\n" * 3000)
    pieces = S.read_csv_files(S.scan_bundle(spark, str(tmp_path)), tasks=6, split_bytes=5000)
    parts = pieces.select("filename", "block", F.spark_partition_id().alias("task")).distinct().groupBy("filename")
    for row in parts.agg(F.count_distinct("block").alias("blocks"), F.count_distinct("task").alias("tasks")).collect():
        assert row.blocks > 4 and row.tasks > 1
    one = contents(S.read_bundle(spark, str(tmp_path), split_bytes=1 << 30))
    assert contents(S.read_bundle(spark, str(tmp_path), split_bytes=5000)) == one
    assert len(one["plain.csv"]) == len(one["quoted.csv"]) == 4000 and one["stops.csv"] == ["long"] * 3000
    assert one["quoted.csv"][7] == 'line 7 with "quotes" and breaks'


def test_json_items_equal_the_module(monkeypatch):
    rng = random.Random(8)

    def value(depth=0):
        if rng.random() < 0.3 or depth > 2:
            return rng.choice(['a"b', "x,y", "[z]", "{", "\\", "é😀", 1, 2.5, None, True])
        if rng.random() < 0.5:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice("abc"): value(depth + 1) for _ in range(rng.randint(0, 3))}

    for _ in range(2000):
        text = json.dumps([value() for _ in range(rng.randint(0, 6))], ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        if rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", ",", "]", '"', "}"]) + text[at + 1 :]
        monkeypatch.setattr(json_items, "READ_BYTES", rng.choice([1, 2, 5, 1000]))
        try:
            want = json.loads(text)
            want = want if isinstance(want, list) else None
        except ValueError:
            want = None
        try:
            got = [json.loads(item) for item in json_items.checked_items(json_items.decoded(io.BytesIO(text.encode())))]
        except ValueError:
            got = None
        assert got == want, text


def test_long_json_lists_in_bounded_parts(spark, tmp_path):
    objects = [{"k": "v", "text": f"the text of number {i}"} for i in range(3000)]
    objects[5], objects[1700] = {"k": "only"}, 7
    (tmp_path / "long.json").write_text(json.dumps(objects))
    (tmp_path / "tail.json").write_text(json.dumps(objects) + "]")
    (tmp_path / "item.json").write_text(json.dumps(objects)[:-2] + "}]]")
    (tmp_path / "words.json").write_text(json.dumps(["word"] * 5000))
    (tmp_path / "one.json").write_text(json.dumps({"a": "x" * 9000}))
    got = contents(S.read_bundle(spark, str(tmp_path), block_bytes=4096))
    assert got == {"long.json": [f"the text of number {i}" for i in range(3000) if i not in (5, 1700)], "one.json": ["x" * 9000]}
    with (tmp_path / "long.json").open("rb") as stream:
        blocks = list(json_items.item_blocks(json_items.list_items(json_items.decoded(stream)), 4096))
    assert max(len(text) for _, text in blocks) <= 4200 and len(blocks) > 20
    run = S.write_bundle(spark, str(tmp_path), str(tmp_path / "out"))
    assert {r.filename for r in run.errors.collect()} == {"tail.json", "item.json", "words.json"}


def test_one_run_gives_rows_errors_and_counts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "blank.csv").write_bytes(b"h\n\nx\n")
    (source / "a.txt").write_text("one\ntwo\n")
    with zipfile.ZipFile(source / "in.zip", "w") as archive:
        archive.writestr("bad.json", "{")
        archive.writestr("b.csv", "h\nvalue\n")
    (source / "README").write_text("no archive")
    with zipfile.ZipFile(source / "bundle", "w") as archive:
        archive.writestr("c.txt", "from an archive without a name")
    run = S.write_bundle(spark, str(source), str(tmp_path / "out"))
    assert {r.content for r in run.rows.collect()} == {"one", "two", "value", "from an archive without a name"}
    errors = {r.filename: r.error for r in run.errors.collect()}
    assert errors == {"blank.csv": "the first data row is blank", "bad.json": S.NO_JSON_VALUE, "README": S.NOT_READABLE}
    assert run.counts == {"rows": 4, "errors": 3, "characters": 11 + len("from an archive without a name")}
    assert {r.filename for r in S.bundle_errors(spark, str(source)).collect()} == set(errors)
