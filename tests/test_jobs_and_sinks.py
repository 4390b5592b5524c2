import gzip
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sievetext.functions.encoders import HashEncoder
from sievetext.plans.trim import match_archive, match_archive_to_lines
from sievetext.sources import filter_files, jobs, sinks
from sievetext.sources.bundle import read_bundle


def test_filter_file(spark, tmp_path):
    path = tmp_path / "keywords.csv"
    path.write_text("pets, my dog is big , ,the cat sleeps\n work ,meeting at noon\nempty,, ,\npets,another pet line\n")
    rows = [tuple(r) for r in jobs.scan_filter_csv(spark, str(path)).orderBy("ord").collect()]
    assert rows == [
        (0, "pets", ["my dog is big", "the cat sleeps"]),
        (1, " work ", ["meeting at noon"]),
        (3, "pets", ["another pet line"]),
    ]


def test_filter_file_with_odd_bytes(spark, tmp_path):
    path = tmp_path / "keys.csv"
    path.write_bytes(b"\xef\xbb\xbfcat,a\rcat2,b\r\ncat3,c\xffd\n")
    rows = [(r.category, r.anchors) for r in jobs.scan_filter_csv(spark, str(path)).orderBy("ord").collect()]
    assert rows == [("cat", ["a"]), ("cat2", ["b"]), ("cat3", ["c\ufffdd"])]


def test_broken_records_of_filter_files(spark, tmp_path, monkeypatch):
    path = tmp_path / "keys.csv"
    path.write_text('a,one\n\nb,"open\nc,two\r\nd,"x\ny"\r"e,open again\nf,three\ng,four,\n')
    good = [(r.ord, r.category, r.anchors) for r in jobs.scan_filter_csv(spark, str(path)).orderBy("ord").collect()]
    assert good == [(0, "a", ["one"]), (1, "b", ["open\nc,two\r\nd,x"]), (4, "f", ["three"]), (5, "g", ["four"])]
    assert [tuple(r) for r in jobs.scan_filter_errors(spark, str(path)).collect()] == [(3, 6, "a quote is not closed")]
    last = list(filter_files.records(['a,b\n', 'c,"open to the end']))
    assert last == [(0, ["a", "b"]), (1, ["c", "open to the end"])]
    monkeypatch.setattr(filter_files, "RECORD_CHARS", 20)
    many = list(filter_files.records(['a,"b\n', *["x,y\n"] * 9, 'c,d\n']))
    assert many == [(0, None), *((i, ["x", "y"]) for i in range(1, 10)), (10, ["c", "d"])]
    assert list(filter_files.records([])) == []


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, text in members.items():
            out.writestr(name, text)
    return str(path)


def test_match_job_on_one_archive(spark, tmp_path):
    keys = "weather,rain and snow today,cold wind\nfood,bread and cheese\nempty, ,\n"
    data = 'id,text\na,"rain and\nsnow today"\nb,bread and cheese\nc,nothing of that kind at all here\nd,\n'
    path = zipped(tmp_path / "upload_1.zip", {"job/Keywords.csv": keys, "job/data.csv": data, "__MACOSX/job/._keys.csv": "x"})
    rows = {(r.filename, r.category) for r in match_archive(spark, path, HashEncoder(128), threshold=0.7, tasks=3).collect()}
    assert rows == {("a", "weather"), ("b", "food")}
    match_archive_to_lines(spark, path, str(tmp_path / "out"), HashEncoder(128), threshold=0.7)
    lines = {r.value for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert lines == {'a : weather : "rain and snow today"', 'b : food : "bread and cheese"'}
    with pytest.raises(Exception, match="no column 2"):
        match_archive(spark, path, HashEncoder(128), index=2).collect()
    assert match_archive(spark, path, HashEncoder(128), index=2, strict=False).count() == 0


def test_inputs_of_archives(spark, tmp_path):
    both = {"in/keys.csv": "a,b\n", "in/rows.csv": "h\nx\n"}
    found = jobs.archive_inputs(spark, zipped(tmp_path / "a.zip", both))
    assert found["filters"].first().filename == "in/keys.csv" and found["data"].first().member_no == 1
    with pytest.raises(ValueError, match="no data member"):
        jobs.archive_inputs(spark, zipped(tmp_path / "b.zip", {"keys.csv": "x"}))
    with pytest.raises(ValueError, match="2 filters members"):
        jobs.archive_inputs(spark, zipped(tmp_path / "c.zip", {**both, "other/KEY.CSV": "x"}))
    # the folder that all share does not count, another one does
    shared = jobs.archive_inputs(spark, zipped(tmp_path / "d.zip", {f"__MACOSX/{k}": v for k, v in both.items()}))
    assert set(shared) == {"filters", "data"}
    with pytest.raises(ValueError, match="no filters member"):
        jobs.archive_inputs(spark, zipped(tmp_path / "e.zip", {"__MACOSX/keys.csv": "x", "rows.csv": "x"}))


def test_data_file(spark, tmp_path):
    path = tmp_path / "data_1.csv"
    path.write_text('filename,content\na,"say ""hi"", you"\nb,\nc,x,extra,cells\n"d",""\n,no name\n')
    rows = {tuple(r) for r in jobs.scan_data_csv(spark, str(path), 1).collect()}
    assert rows == {("a", 'say "hi", you'), ("b", ""), ("c", "x"), ("d", ""), ("", "no name")}
    first = {tuple(r) for r in jobs.scan_data_csv(spark, str(path), 0).collect()}
    assert ("c", "c") in first and len(first) == 5


def test_data_file_with_short_rows(spark, tmp_path):
    path = tmp_path / "data_2.csv"
    path.write_text(
        'f,g,content\na,b,c\nshort,row\nd,e,\nf,,h,i\nj,k,,l\n"m,n",o\np,"q, ""r, s",,t\nu"v,w"x\n'
    )
    lenient = {tuple(r) for r in jobs.scan_data_csv(spark, str(path), 2, strict=False).collect()}
    assert lenient == {("a", "c"), ("d", ""), ("f", "h"), ("j", ""), ("p", "")}
    with pytest.raises(Exception, match="no column 2"):
        jobs.scan_data_csv(spark, str(path), 2).collect()


def test_data_file_with_line_breaks(spark, tmp_path):
    path = tmp_path / "data_1.csv"
    path.write_text('f,content\na,"one\ntwo"\nb,three\n')
    rows = {tuple(r) for r in jobs.scan_data_csv(spark, str(path), 1, multi_line=True).collect()}
    assert rows == {("a", "one\ntwo"), ("b", "three")}


def test_column_index_of_parts(spark):
    parts = spark.createDataFrame([(0, "a_3.zip"), (1, "b.zip"), (2, "c_5.zip"), (3, "d.zip")], "n int, name string")
    assert jobs.column_index_of_parts(parts, "name", "n").first().column_index == 5
    assert jobs.column_index_of_parts(parts.filter("n = 1"), "name", "n").first().column_index == 0
    assert jobs.column_index_of_parts(parts.filter("false"), "name", "n").first().column_index == 0


def test_find_inputs(spark, tmp_path):
    root = tmp_path / "UPLOAD"
    root.mkdir()
    (root / "input_data.csv").write_text("x\n")
    (root / "notes.txt").write_text("x\n")
    (tmp_path / "__MACOSX").mkdir()
    (tmp_path / "__MACOSX" / "._keys.csv").write_text("x\n")
    with pytest.raises(ValueError, match="no filters file"):
        jobs.find_inputs(spark, str(tmp_path))
    (root / "My_KEYwords.CSV").write_text("x\n")
    filters, data = jobs.find_inputs(spark, str(tmp_path))
    assert filters.endswith("My_KEYwords.CSV") and data.endswith("input_data.csv")
    (root / "second.csv").write_text("x\n")
    with pytest.raises(ValueError, match="2 data files"):
        jobs.find_inputs(spark, str(tmp_path))


@pytest.fixture(scope="module")
def matches(spark):
    rows = [("a.txt", "pets", 5, 0.9, 'he said "hi"\nbye'), ("b.txt", "", 6, 0.8, "x"), ("c.txt", "a/b=c", 7, 0.7, "y, z")]
    return spark.createDataFrame(rows, "filename string, category string, dist int, score double, content string")


def test_write_lines(matches, tmp_path):
    sinks.write_lines(matches, str(tmp_path / "out"))
    lines = []
    for part in Path(tmp_path / "out").glob("*.gz"):
        lines += gzip.decompress(part.read_bytes()).decode().splitlines()
    assert sorted(lines) == ["a.txt : pets : \"he said 'hi' bye\"", 'b.txt :  : "x"', 'c.txt : a/b=c : "y, z"']


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_write_matches(spark, matches, tmp_path, fmt):
    sinks.write_matches(matches, str(tmp_path / "out"), fmt=fmt)
    back = spark.read.option("header", "true").option("escape", '"').format(fmt).load(str(tmp_path / "out"))
    rows = {(r.category or "", float(r.score), r.data) for r in back.select("category", "score", "data").collect()}
    assert rows == {("pets", 0.9, "he said 'hi' bye"), ("", 0.8, "x"), ("a/b=c", 0.7, "y, z")}
    blanks = matches.selectExpr("filename", "' cat ' as category", "dist", "score", "'  lead' as content").limit(1)
    sinks.write_matches(blanks, str(tmp_path / "blanks"), fmt=fmt)
    back = spark.read.option("header", "true").option("escape", '"').format(fmt).load(str(tmp_path / "blanks"))
    assert back.first().category == " cat "


def test_normalized_corpus_round_trip(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text('one, "two"\nthree\\\n')
    (source / "b.csv").write_text("h,k\nx,long\ny,\n")
    corpus = read_bundle(spark, str(source), tasks=1)
    want = {tuple(r) for r in corpus.select("filename", "content").collect()}
    assert ("b.csv", "") in want and ("a.txt", 'one "two"') in want and ("a.txt", "three\\") in want
    sinks.write_normalized(corpus, str(tmp_path / "csv"), "csv")
    assert {tuple(r) for r in jobs.scan_data_csv(spark, str(tmp_path / "csv"), 1).collect()} == want
    sinks.write_normalized(corpus, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == len(want)


def test_write_filters(spark, tmp_path):
    filters = spark.createDataFrame([(0, "a", ["x", "y"])], "ord long, category string, anchors array<string>")
    for fmt in ("parquet", "json"):
        sinks.write_filters(filters, str(tmp_path / fmt), fmt)
        back = spark.read.schema(filters.schema).format(fmt).load(str(tmp_path / fmt))
        assert back.first().anchors == ["x", "y"]
    assert filters.select(F.size("anchors").alias("n")).first().n == 2


def test_matches_by_category_in_few_files(spark, tmp_path):
    names = "if(id < 60000, 'hot', concat('small ', id % 1000))"
    rows = spark.range(0, 64000, 1, 16).selectExpr(
        f"{names} as category", "1.0D as score", "repeat(cast(id as string), 40) as content", "'f' as filename", "cast(id as int) as dist"
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300000")
    try:
        sinks.write_matches(rows, str(tmp_path / "out"), by_category=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {}
    for file in (tmp_path / "out").rglob("*.parquet"):
        files.setdefault(file.parent.name, []).append(file)
    assert len(files) == 1001
    assert len(files.pop(f"{sinks.FOLDER}=hot")) > 3 and max(map(len, files.values())) <= 2
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 64000 and back.where("category = 'small 7'").count() == 4
    odd = spark.createDataFrame([(c, 1.0, "t", "f", 1) for c in ("", None, " a/b=c ")], "category string, score double, content string, filename string, dist int")
    for fmt in ("parquet", "csv"):
        sinks.write_matches(odd, str(tmp_path / fmt), fmt=fmt, by_category=True)
    assert {r.category for r in spark.read.parquet(str(tmp_path / "parquet")).collect()} == {"", None, " a/b=c "}
