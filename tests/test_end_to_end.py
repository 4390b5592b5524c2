import zipfile

import pytest
from pyspark.sql import functions as F

from sievetext import HashEncoder, VectorTable, embed, embed_filters, trim_corpus
from sievetext.operators.intents import build_filter_table, route_requests
from sievetext.sources import jobs, sinks
from sievetext.sources.bundle import read_bundle
from sievetext.streaming.trim import trim_stream, write_stream
from tests.test_intents import SCHEMA

ENCODER = HashEncoder(384)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("e2e") / "in.zip"
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("notes.txt", "the burglary happened at night\n\nlunch was fine, really\nburglary at night the\n")
        out.writestr("mail.csv", "id,body\n1,at night the burglary happened\n2,see you tomorrow\n")
        out.writestr("log.json", '[{"level":"info","message":"nothing to see"},{"message":"the burglary happened at night"}]')
    return read_bundle(spark, str(path), tasks=2)


@pytest.fixture(scope="module")
def filters(spark):
    request = spark.createDataFrame([(0, True, "the burglary happened at night; weather report", None, "in.zip")], SCHEMA)
    return build_filter_table(route_requests(request, separators=";"))


def test_from_bundle_to_lines(corpus, filters, tmp_path, spark):
    matches = trim_corpus(corpus, filters, ENCODER)
    sinks.write_lines(matches, str(tmp_path / "lines"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect())
    category = "the_burglary_happene"
    assert lines == [
        f'log.json : {category} : "the burglary happened at night"',
        f'mail.csv : {category} : "at night the burglary happened"',
        f'notes.txt : {category} : "burglary at night the"',
        f'notes.txt : {category} : "the burglary happened at night"',
    ]
    perfect = matches.filter("dist = 0").count()
    assert perfect == 3


def test_through_the_file_formats(spark, corpus, filters, tmp_path):
    sinks.write_normalized(corpus, str(tmp_path / "data"), "csv")
    back = jobs.scan_data_csv(spark, str(tmp_path / "data"), 1)
    direct = trim_corpus(corpus, filters, ENCODER).select("filename", "category", "dist", "content")
    again = trim_corpus(back, filters, ENCODER).select("filename", "category", "dist", "content")
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, again.collect()))


def test_result_does_not_depend_on_partitions(corpus, filters):
    results = set()
    for parts in (1, 4, 50):
        rows = trim_corpus(corpus.repartition(parts), filters, ENCODER).select("filename", "content", "dist", "ord")
        results.add(tuple(sorted(map(tuple, rows.collect()))))
    assert len(results) == 1


def test_precomputed_vectors_give_the_same_result(corpus, filters):
    anchors = filters.select(F.explode("anchors").alias("content"))
    texts = corpus.select("content").union(anchors).distinct()
    table = VectorTable(embed(texts, ENCODER, "content", "e"), "content", "e")
    want = trim_corpus(corpus, filters, ENCODER).select("filename", "content", "ord", "dist")
    got = trim_corpus(corpus, filters, table).select("filename", "content", "ord", "dist")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_filters_no_output(spark, corpus, filters):
    assert trim_corpus(corpus, filters.filter("false"), ENCODER).count() == 0


def test_stream_equals_batch(spark, small, filters, tmp_path):
    docs = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("content"))
    source = tmp_path / "source"
    for i in range(3):
        docs.filter(F.pmod("turn", F.lit(3)) == i).coalesce(1).write.mode("append").parquet(str(source))
    anchors = docs.filter("turn = 1").select(
        F.col("conv_id").alias("ord"), F.concat(F.lit("c"), "conv_id").alias("category"), F.array("content").alias("anchors")
    )
    bank = embed_filters(anchors, ENCODER)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = write_stream(trim_stream(stream, bank, ENCODER), str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(300)
    from sievetext.functions.text import normalize_text

    normal = docs.withColumn("content", normalize_text(F.col("content")))
    want = trim_corpus(normal, anchors, ENCODER).select("conv_id", "turn", "category", "dist")
    got = spark.read.parquet(str(tmp_path / "out")).select("conv_id", "turn", "category", "dist")
    assert want.count() > 10
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_observed_counts(spark, corpus, filters):
    from pyspark.sql import Observation

    from sievetext.plans.trim import observed

    rows_in, rows_out = Observation(), Observation()
    matches = observed(trim_corpus(observed(corpus, rows_in), filters, ENCODER), rows_out)
    matches.write.format("noop").mode("overwrite").save()
    assert (rows_in.get["rows"], rows_out.get["rows"]) == (corpus.count(), 4)
