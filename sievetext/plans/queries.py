"""The registered queries: every operator over whole tables.

Each takes (spark, folder of parquet tables).  ``oracles.py`` has the SQL twins.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import text as T
from ..functions.encoders import HashEncoder, ModelEncoder, VectorTable, register_encoder
from ..operators import intents, matching, vectors
from ..session import shared_dir
from ..sources import bundle, extract, filter_files, jobs, sinks
from ..sources.datasource import FORMAT, bundle_rows, register_bundle_source
from ..streaming.trim import trim_stream, write_stream
from .trim import SIMILARITY_THRESHOLD, match_archive_to_lines, trim_against, trim_vectors

EMBEDDING_DIM = 64
ENCODER = HashEncoder(384)
CATEGORIES = 5
QUERY_TEMPLATES = ("has anyone seen {query}", "{query} again", "I read about {query} today")
FIELD_TEMPLATES = ("{importantEvents} happened in {importantLocation}", "{desiredOutcome} near {importantLocation}")

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---------------------------------------------------------------- vectors and matching
def _label_anchors(spark, folder) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return rows.select(
        F.col("label").cast("long").alias("ord"),
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("category"),
        "embedding",
    )


def _label_filters(spark, folder) -> DataFrame:
    return vectors.centroid_filters(_label_anchors(spark, folder), "embedding")


def _embedding_bits(spark, folder) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return rows.select("vec_id", B.vector_bits()("embedding").alias("bits"))


def _embedding_matches(spark, folder) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return trim_vectors(rows, _label_filters(spark, folder))


def _match_columns(matches: DataFrame, *keys: str) -> DataFrame:
    return matches.select(*keys, "ord", "category", "dist", F.round("score", 6).alias("score"))


@query
def binarize_vectors(spark, folder):
    text = B.bit_string(F.col("bits"), EMBEDDING_DIM)
    rows = _embedding_bits(spark, folder).select("vec_id", text.alias("bit_string"))
    ones = F.length(F.replace(F.col("bit_string"), F.lit("0"), F.lit("")))
    return rows.withColumn("ones", ones.cast("int"))


@query
def unit_vectors(spark, folder):
    rows = table(spark, folder, "embeddings")
    cells = rows.select("vec_id", F.posexplode(B.l2_normalize(F.col("embedding"))).alias("pos", "x"))
    return cells.select("vec_id", "pos", F.round("x", 6).alias("x"))


@query
def label_centroids(spark, folder):
    rows = table(spark, folder, "embeddings")
    sums = vectors.centroid_sum(rows, ["label"], "embedding")
    cells = sums.select("label", F.posexplode("centroid").alias("pos", "x"))
    return cells.select("label", "pos", F.round("x", 6).alias("total"))


@query
def masked_pool(spark, folder):
    rows = table(spark, folder, "embeddings")
    tokens = rows.select("label", "embedding", (F.col("embedding")[0] > 0).cast("int").alias("mask"))
    pooled = vectors.masked_mean_pool(tokens, ["label"], "embedding", "mask")
    cells = pooled.select("label", F.posexplode("pooled").alias("pos", "x"))
    return cells.select("label", "pos", F.round("x", 6).alias("mean"))


@query
def nearest_label(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return _match_columns(matching.best_match_vectors(rows, _label_filters(spark, folder)), "vec_id")


@query
def nearest_label_from_bits(spark, folder):
    return _match_columns(
        matching.best_match(_embedding_bits(spark, folder), _label_filters(spark, folder)), "vec_id"
    )


@query
def trim_embeddings(spark, folder):
    return _match_columns(_embedding_matches(spark, folder), "vec_id")


@query
def score_matrix(spark, folder):
    scored = matching.score_all(_embedding_bits(spark, folder), _label_filters(spark, folder))
    return _match_columns(scored, "vec_id")


@query
def match_summary(spark, folder):
    summary = matching.match_summary(_embedding_matches(spark, folder))
    return summary.select(
        "category", "n_rows", F.round("avg_score", 6).alias("avg_score"), F.round("max_score", 6).alias("max_score")
    )


@query
def reduction(spark, folder):
    rows = table(spark, folder, "embeddings")
    matched = matching.best_match_vectors(rows.select("vec_id", "embedding"), _label_filters(spark, folder))
    totals = matching.reduction_of(matched, SIMILARITY_THRESHOLD)
    return totals.select("rows_in", "rows_out", F.round("kept", 6).alias("kept"))


@query
def top_matches(spark, folder):
    top = matching.top_k_per_category(_embedding_matches(spark, folder), 3, "vec_id")
    return top.select("category", "rank", "vec_id", "dist")


@query
def tie_break(spark, folder):
    filters = _label_filters(spark, folder)
    later = filters.select(
        (F.col("ord") + 1000).alias("ord"), F.concat(F.lit("again_"), "category").alias("category"), "dim", "bits"
    )
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return _match_columns(matching.best_match_vectors(rows, later.unionByName(filters)), "vec_id")


@query
def precomputed_matches(spark, folder):
    items = table(spark, folder, "benchmark").select("item_id")
    encoder = VectorTable(table(spark, folder, "embeddings"), "vec_id", "embedding")
    rows = encoder.attach(items, "item_id", "embedding")
    return _match_columns(matching.best_match_vectors(rows, _label_filters(spark, folder)), "item_id")


@query
def trim_stream_embeddings(spark, folder):
    """The stream runs to the end of its input and is read back from the shared folder."""
    schema = table(spark, folder, "embeddings").schema
    # Written as a pattern, the path may be one file or a folder of files.
    source = f"{folder}/embeddings.parque[t]"
    stream = spark.readStream.schema(schema).parquet(source).select("vec_id", "embedding")
    run = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    matches = _match_columns(trim_stream(stream, _label_filters(spark, folder)), "vec_id")
    write_stream(matches, f"{run}/rows", f"{run}/state").awaitTermination()
    return spark.read.schema(matches.schema).parquet(f"{run}/rows")


# ---------------------------------------------------------------- files
def _new_folder(spark) -> str:
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


@query
def text_bundle(spark, folder):
    """The documents written as text files and read back as a bundle."""
    path = _new_folder(spark)
    table(spark, folder, "documents").select("text").write.text(path)
    return bundle.read_bundle(spark, path).select("content")


def _write_archives(spark, rows: DataFrame, tasks: int | None = None) -> str:
    """Write rows (archive, name, place, value) as zip files and return their folder.

    The values of one name, in order of place, are one member; a null value is empty.  A task streams
    the archives that fall to it; a retried one writes the same files again.
    """
    path = _new_folder(spark)

    def task(batches):
        files, root = bundle.filesystem_of(path)
        files.create_dir(root, recursive=True)
        archive_name = name = out = archive = member = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != archive_name:
                    if archive is not None:
                        member.close()
                        archive.close()
                        out.close()
                    archive_name, name = row["archive"], None
                    out = files.open_output_stream(f"{root}/{archive_name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                if row["name"] != name:
                    if name is not None:
                        member.close()
                    name = row["name"]
                    member = archive.open(name, "w", force_zip64=True)
                member.write((row["value"] or "").encode())
        if archive is not None:
            member.close()
            archive.close()
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([archive_name])], names=["archive"])

    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    sorted_ = rows.select("archive", "name", "place", "value").repartition(tasks, "archive").sortWithinPartitions("archive", "name", "place")
    sorted_.mapInArrow(task, "archive string").write.format("noop").mode("overwrite").save()
    return path


def _member(name, value, place=0) -> list:
    """Columns of ``_write_archives`` for small members, spread over archives by name."""
    archive = F.concat(F.pmod(F.xxhash64(name), F.lit(32)), F.lit(".ZIP"))
    return [archive.alias("archive"), name.alias("name"), F.lit(place).cast("long").alias("place"), value.alias("value")]


def _quoted(text: str) -> F.Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


@query
def archive_bundle(spark, folder):
    """Documents as .txt, conversations' turns as .csv and .json members of zip files, read as a bundle."""
    turns = table(spark, folder, "conversations").filter("text is not null")
    named = F.concat("conv_id", F.lit("-"), "turn")
    members = (
        table(spark, folder, "documents").select(_member(F.concat("doc_id", F.lit(".txt")), F.col("text")))
        .unionByName(turns.select(_member(F.concat(named, F.lit(".csv")), F.concat(F.lit("a,b\n,"), _quoted("text")))))
        .unionByName(turns.select(_member(F.concat(named, F.lit(".json")), F.to_json(F.array(F.struct("text"))))))
    )
    return bundle.read_bundle(spark, _write_archives(spark, members)).select("filename", "content")


@query
def csv_files(spark, folder):
    """The documents written as plain CSV files, line breaks inside quotes, and read by splits of 256 KB."""
    path = _new_folder(spark)
    docs = table(spark, folder, "documents").select(F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("n"))
    docs.write.option("header", "true").option("quoteAll", "true").option("escape", '"').option(
        "ignoreLeadingWhiteSpace", "false"
    ).option("ignoreTrailingWhiteSpace", "false").csv(path)
    return bundle.read_bundle(spark, path, split_bytes=1 << 18).select("content")


@query
def json_list_files(spark, folder):
    """The documents as items of JSON lists in zip members, which are read item by item, 64 KB at a time."""
    archive = F.concat(F.pmod(F.xxhash64("doc_id"), F.lit(8)), F.lit(".zip"))
    row = [archive.alias("archive"), F.lit("docs.json").alias("name")]
    items = table(spark, folder, "documents").select(
        *row, F.col("doc_id").alias("place"), F.concat(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"))), F.lit(",")).alias("value")
    )
    # the first item's value is the longest of its object, the last one has no key and gives nothing
    ends = items.select("archive", "name").distinct().select(
        "archive", "name", F.explode(F.array(F.struct(F.lit(-1).alias("place"), F.lit('[').alias("value")), F.struct(F.lit(2**62).alias("place"), F.lit("{}]").alias("value")))).alias("end")
    )
    path = _write_archives(spark, items.unionByName(ends.select("archive", "name", "end.place", "end.value")))
    return bundle.read_bundle(spark, path, block_bytes=1 << 16).select("filename", "content")


@query
def bundle_format(spark, folder):
    """Turns as members of zip files: read by the data source's format, and as a stream of arriving archives."""
    register_bundle_source(spark)
    turns = table(spark, folder, "conversations").filter("text is not null")
    kind = F.element_at(F.array(F.lit("txt"), F.lit("json"), F.lit("csv")), (F.col("turn") % 3 + 1).cast("int"))
    value = F.when(kind == "txt", F.col("text")).when(kind == "json", F.to_json(F.struct("text"))).otherwise(F.concat(F.lit("a,b\n,"), _quoted("text")))
    named = F.concat("conv_id", F.lit("-"), "turn", F.lit("."), kind)
    path = _write_archives(spark, turns.select(_member(named, value)))
    batch = bundle_rows(spark.read.format(FORMAT).load(path))
    run = _new_folder(spark)
    arriving = bundle_rows(spark.readStream.format(FORMAT).option("settle", 0).load(path))
    write_stream(arriving, f"{run}/rows", f"{run}/state").awaitTermination()
    stream = spark.read.schema(arriving.schema).parquet(f"{run}/rows")
    both = batch.withColumn("how", F.lit("batch")).unionByName(stream.withColumn("how", F.lit("stream")))
    return both.select("how", "filename", "content")


@query
def bundle_run(spark, folder):
    """Turns as JSON members, some of them broken: rows and errors of one reading, counted while it ran."""
    turns = table(spark, folder, "conversations")
    broken = F.when(F.col("turn") % 3 == 1, F.lit("]")).otherwise(F.lit(""))
    value = F.concat(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"))), broken)
    members = turns.select(_member(F.concat("conv_id", F.lit("-"), "turn", F.lit(".json")), value))
    run = bundle.write_bundle(spark, _write_archives(spark, members), _new_folder(spark))
    rows = run.rows.select("filename", F.lit("row").alias("kind"), "content")
    errors = run.errors.select("filename", F.lit("error").alias("kind"), F.col("error").alias("content"))
    counts = [F.lit(run.counts[name]).cast("long").alias(name) for name in ("rows", "errors", "characters")]
    return rows.unionByName(errors).select("*", *counts)


@query
def filter_files_read(spark, folder):
    """Every item as a filter file of three records, the second one broken in every third file."""
    items = table(spark, folder, "benchmark")
    cells = F.array_join(F.transform(F.split("text", r"\."), lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))), ",")
    second = F.when(F.col("item_id") % 3 == 0, F.lit('broken,"never closed')).otherwise(F.lit("whole,closed"))
    value = F.concat_ws("\n", F.concat(F.lit("first,"), cells), second, F.concat(F.lit("last,"), F.lit("item "), F.col("item_id").cast("string")))
    members = items.select(_member(F.concat("item_id", F.lit(".csv")), value))
    found = filter_files.read_filter_records(bundle.scan_bundle(spark, _write_archives(spark, members)))
    good = jobs.filters_of_records(found).select("filename", "ord", "category", F.array_join("anchors", "|").alias("anchors"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(filter_files.filter_errors(found).drop("line_no"), allowMissingColumns=True)


@query
def archive_match(spark, folder):
    """Archives of a key file and a share of the documents each, matched one by one to result lines."""
    path = _new_folder(spark)
    docs = table(spark, folder, "documents")
    # an archive's data is one member, read by one task: more documents are more archives
    archives = [f"part{i}_1.zip" for i in range(2 + docs.count() // 50_000)]
    which = F.element_at(F.array(*map(F.lit, archives)), (F.pmod("doc_id", F.lit(len(archives))) + 1).cast("int"))
    line = F.concat(_quoted("source"), F.lit(","), _quoted(T.normalize_text(F.col("text"))), F.lit("\n"))
    data = docs.select(which.alias("archive"), F.lit("job/data.csv").alias("name"), F.col("doc_id").alias("place"), line.alias("value"))
    # a category's anchors are one record of the format, whatever their number
    anchors = _benchmark_anchors(spark, folder).groupBy("ord", "category").agg(F.array_join(F.collect_list(_quoted("anchor")), ",").alias("cells"))
    keys = anchors.select(F.lit("job/Keywords.csv").alias("name"), F.col("ord").alias("place"), F.concat_ws(",", "category", "cells").alias("value"))
    keys = keys.withColumn("value", F.concat("value", F.lit("\n")))
    header = spark.createDataFrame([("job/data.csv", -1, "filename,content\n")], "name string, place long, value string")
    each = keys.unionByName(header).withColumn("archive", F.explode(F.array(*map(F.lit, archives))))
    written = _write_archives(spark, data.unionByName(each))
    for archive in archives:
        match_archive_to_lines(spark, f"{written}/{archive}", f"{path}/{archive}", ENCODER)
    return spark.read.text([f"{path}/{archive}" for archive in archives]).select(F.col("value").alias("line"))


@query
def data_csv(spark, folder):
    """The normalised documents written as a data CSV and read back by column index."""
    path = _new_folder(spark)
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("filename"), "text")
    rows = docs.select("filename", T.normalize_text(F.col("text")).alias("content"))
    sinks.write_normalized(rows, path, "csv")
    return jobs.scan_data_csv(spark, path, 1)


def _document_matches(spark, folder) -> DataFrame:
    """Documents with a category and a score of their own, as the sinks get them."""
    docs = table(spark, folder, "documents")
    dist = (F.col("doc_id") % 64).cast("int")
    return docs.select(
        "doc_id", F.col("source").alias("filename"), F.concat(F.lit(" "), "lang", F.lit(" ")).alias("category"), F.col("text").alias("content"),
        dist.alias("dist"), (F.lit(1.0) - dist / F.lit(64.0)).alias("score"),
    )


@query
def match_table(spark, folder):
    """Documents written as the result table, as parquet and as CSV, and read back."""
    path = _new_folder(spark)
    rows = _document_matches(spark, folder)
    sinks.write_matches(rows, f"{path}/parquet")
    sinks.write_matches(rows, f"{path}/csv", fmt="csv")
    schema = "category string, score double, data string, filename string, dist int"
    stored = spark.read.parquet(f"{path}/parquet").withColumn("fmt", F.lit("parquet"))
    text = spark.read.schema(schema).option("header", "true").option("escape", '"').option("emptyValue", "").csv(f"{path}/csv")
    both = stored.unionByName(text.withColumn("fmt", F.lit("csv")))
    return both.select("fmt", "category", F.round("score", 6).alias("score"), F.coalesce("data", F.lit("")).alias("data"), "filename", "dist")


@query
def match_table_by_category(spark, folder):
    """Documents written as a result table with a folder for each category, and read back."""
    path = _new_folder(spark)
    sinks.write_matches(_document_matches(spark, folder), path, by_category=True)
    stored = spark.read.schema(f"category string, score double, data string, filename string, dist int, {sinks.FOLDER} string").parquet(path)
    return stored.select("category", F.round("score", 6).alias("score"), "data", "filename", "dist", F.col(sinks.FOLDER).alias("folder"))


@query
def line_files(spark, folder):
    """Documents written as compressed result lines and read back."""
    path = _new_folder(spark)
    sinks.write_lines(_document_matches(spark, folder), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# ---------------------------------------------------------------- text
@query
def normalize_docs(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", T.normalize_text(F.col("text")).alias("content"))


@query
def doc_lines(spark, folder):
    files = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("filename"), F.col("text").alias("content")
    )
    return extract.extract_txt_lines(files)


@query
def decode_docs(spark, folder):
    docs = table(spark, folder, "documents")
    broken = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")), F.col("lang").cast("binary"))
    return docs.select("doc_id", T.decode_lossy(broken).alias("content"))


@query
def clean_lines(spark, folder):
    docs = table(spark, folder, "documents")
    rows = docs.select("doc_id", F.col("source").alias("filename"), F.col("lang").alias("category"), "text")
    line = T.render_line(F.col("filename"), F.col("category"), F.col("text"))
    return rows.select("doc_id", line.alias("line"))


@query
def scored_lines(spark, folder):
    docs = table(spark, folder, "documents")
    score = F.lit(1.0) - F.pmod(F.col("n_chars"), F.lit(384)) / F.lit(384.0)
    return docs.select("doc_id", T.render_scored_line(F.col("lang"), score, F.col("text")).alias("line"))


@query
def union_corpus(spark, folder):
    def part(name, key, text):
        rows = table(spark, folder, name)
        return rows.select(F.lit(name).alias("filename"), F.col(key).alias("row_no"), T.normalize_text(F.col(text)).alias("content"))

    return extract.union_extracts(
        part("documents", "doc_id", "text"), part("conversations", "conv_id", "text"), part("pages", "page_id", "html")
    )


@query
def longest_prop(spark, folder):
    files = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("filename"), F.col("props").alias("content")
    )
    return extract.extract_json(files).select("filename", "content")


@query
def json_turns(spark, folder):
    turns = table(spark, folder, "conversations")
    name = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    files = turns.select(name.alias("filename"), F.to_json(F.struct("role", "text")).alias("content"))
    return extract.extract_json(files).select("filename", "content")


def _numbered_lines() -> F.Column:
    return F.transform(
        F.split("text", "\n"), lambda line, i: F.struct(i.cast("string").alias("n"), line.alias("body"))
    )


@query
def json_lines(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", _numbered_lines().alias("lines"))
    files = docs.select(F.col("doc_id").cast("string").alias("filename"), F.to_json("lines").alias("content"))
    return extract.extract_json(files)


@query
def csv_lines(spark, folder):
    """Every document as a CSV file of (n, body) rows, read back through the longest column."""
    quoted = F.transform(
        _numbered_lines(),
        lambda line: F.concat(line["n"], F.lit(',"'), F.replace(line["body"], F.lit('"'), F.lit('""')), F.lit('"')),
    )
    docs = table(spark, folder, "documents").select("doc_id", quoted.alias("records"))
    content = F.concat(F.lit("n,body\r\n"), F.array_join("records", "\r\n"))
    files = docs.select(F.col("doc_id").cast("string").alias("filename"), content.alias("content"))
    return extract.extract_csv_longest(files)


@query
def longest_part_column(spark, folder):
    """The longest cell of the first part decides the column that all parts give."""
    parts = table(spark, folder, "part")
    cells = F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    rows = parts.select("p_partkey", cells.alias("cells"))
    first = rows.agg(F.min_by(T.longest_field(F.col("cells")), "p_partkey").alias("i")).scalar()
    return rows.select("p_partkey", F.get(F.col("cells"), first).alias("content"))


@query
def column_index(spark, folder):
    pages = table(spark, folder, "pages")
    index = F.coalesce(T.column_index_from_name(F.col("url")), F.lit(0))
    return pages.select("page_id", index.alias("column_index"))


@query
def column_index_of_parts(spark, folder):
    return jobs.column_index_of_parts(table(spark, folder, "pages"), "url", "page_id")


@query
def input_roles(spark, folder):
    suffix = (
        F.when(F.col("p_type") == "SMALL", F.lit("_Keywords.CSV"))
        .when(F.col("p_type") == "LARGE", F.lit(".csv"))
        .when(F.col("p_type") == "ECONOMY", F.lit(".txt"))
        .otherwise(F.lit(".DS_Store.csv"))
    )
    parts = table(spark, folder, "part")
    paths = parts.select("p_partkey", F.concat("p_brand", F.lit("/"), "p_name", suffix).alias("path"))
    return jobs.classify_inputs(paths)


# ---------------------------------------------------------------- intents
@query
def fallback_filters(spark, folder):
    items = table(spark, folder, "benchmark")
    filters = intents.expand_queries(items.select(F.col("item_id").alias("ord"), F.col("text").alias("query")))
    return filters.select(
        "ord", "category", F.size("anchors").alias("n_anchors"), F.array_join("anchors", "|").alias("anchors")
    )


@query
def anchor_counts(spark, folder):
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("query"))
    return intents.count_anchors(intents.expand_queries(items, QUERY_TEMPLATES))


@query
def template_filters(spark, folder):
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("query"))
    filters = intents.expand_queries(items, QUERY_TEMPLATES)
    return filters.select("ord", "category", F.posexplode("anchors").alias("anchor_no", "anchor"))


@query
def answered_filters(spark, folder):
    """Nations as answers to the customers' queries; an answer may lack either part."""
    customers = table(spark, folder, "customer")
    queries = customers.select(F.col("c_custkey").alias("ord"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("query"))
    category = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")))
    variations = F.when(F.col("c_acctbal") < 5000, F.array("c_name", "c_mktsegment"))
    answers = customers.filter("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_custkey").alias("ord"), category.alias("category"), variations.alias("variations")
    )
    filters = intents.expand_queries(queries, answers=answers)
    return filters.select("ord", "category", F.array_join("anchors", "|").alias("anchors"))


@query
def split_queries(spark, folder):
    items = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("naturalLanguageDescription"))
    return intents.split_description(items, r"[.;\n]").select("item_id", "sub", "query")


@query
def field_anchors(spark, folder):
    nations, regions = table(spark, folder, "nation"), table(spark, folder, "region")
    joined = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    fields = F.struct(
        F.lit("trade").alias("desiredOutcome"),
        F.lit(None).cast("string").alias("importantDate"),
        F.lit("").alias("importantPeople"),
        F.concat("r_name", F.lit(", summit")).alias("importantEvents"),
        F.col("n_name").alias("importantLocation"),
    )
    filters = intents.expand_fields(joined.select("n_nationkey", fields.alias("fields")), FIELD_TEMPLATES)
    return filters.select("n_nationkey", "category", F.posexplode("anchors").alias("anchor_no", "anchor"))


def _requests(spark, folder) -> DataFrame:
    customers = table(spark, folder, "customer")
    fields = F.struct(
        F.col("c_mktsegment").alias("desiredOutcome"),
        F.when(F.col("c_acctbal") > 9000, F.lit("  ")).otherwise(F.lit("12/2/23")).alias("importantDate"),
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("importantPeople"),
        F.concat(F.lit("audit, "), F.lower("c_mktsegment")).alias("importantEvents"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("importantLocation"),
    )
    return customers.select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_nationkey") > 2, F.col("c_nationkey") > 12).alias("usedNaturalLanguage"),
        F.when(F.col("c_acctbal") > 1000, F.concat_ws(" ", "c_mktsegment", "c_name")).alias("naturalLanguageDescription"),
        fields.alias("fields"),
        F.when(F.col("c_acctbal") < 8000, F.lit("in.zip")).alias("fileName"),
    )


@query
def validated_requests(spark, folder):
    checked = intents.validate_requests(_requests(spark, folder))
    return checked.select("request_id", "valid", "message")


@query
def routed_requests(spark, folder):
    routed = intents.route_requests(_requests(spark, folder), field_templates=FIELD_TEMPLATES)
    return routed.select("request_id", "ord", "category", F.array_join("anchors", "|").alias("anchors"))


@query
def request_filters(spark, folder):
    """Filter table of all requests, written and read back; each filter keeps its request."""
    path = _new_folder(spark)
    routed = intents.route_requests(_requests(spark, folder), field_templates=FIELD_TEMPLATES)
    sinks.write_filters(intents.build_filter_table(routed), path)
    rows = spark.read.parquet(path)
    return rows.select("request_id", "ord", "category", F.array_join("anchors", "|").alias("anchors"))


@query
def defaulted_fields(spark, folder):
    filled = intents.defaulted_fields(_requests(spark, folder))
    return filled.select("request_id", "fields.*")


@query
def filter_rows(spark, folder):
    """Every item as one filter file: the sentences of its text are the cells."""
    cells = F.transform(F.split(F.col("text"), r"\."), lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))
    items = table(spark, folder, "benchmark").select("item_id", cells.alias("cells"))
    content = F.concat(F.lit("empty,, ,\r\n"), F.array_join("cells", ","), F.lit("\r\n"))
    files = items.select(F.col("item_id").cast("string").alias("filename"), content.alias("content"))
    return jobs.filters_from_csv(files).select(
        "filename", "ord", "category", F.size("anchors").alias("n_anchors"), F.array_join("anchors", "|").alias("anchors")
    )


# ---------------------------------------------------------------- text to matches
def _benchmark_anchors(spark, folder) -> DataFrame:
    group = F.pmod(F.col("item_id"), F.lit(CATEGORIES)).cast("long")
    return table(spark, folder, "benchmark").select(
        group.alias("ord"), F.concat(F.lit("topic_"), group.cast("string")).alias("category"), F.col("text").alias("anchor")
    )


def _benchmark_filters(spark, folder) -> DataFrame:
    return vectors.embed_anchors(_benchmark_anchors(spark, folder), ENCODER)


@query
def hash_tokens(spark, folder):
    """The sign bits of every distinct token, as the encoder sees them."""
    docs = table(spark, folder, "documents")
    tokens = docs.select(F.explode(F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0)")).alias("token"))
    bits = B.text_bits(ENCODER)("token")
    return tokens.distinct().select("token", B.bit_string(bits, ENCODER.dim).alias("signs"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letter_model(letters: str):
    """A caller's model of the smallest kind: how often each letter occurs."""
    return lambda texts: [[text.count(letter) for letter in letters] for text in texts]


@query
def model_vectors(spark, folder):
    """Documents through a caller's model: as a SQL function, and as bits."""
    encoder = ModelEncoder.sharing(spark, _letter_model, LETTERS, len(LETTERS))
    register_encoder(spark, "letter_vector", encoder)
    docs = table(spark, folder, "documents")
    bits = B.bit_string(B.text_bits(encoder)("text"), encoder.dim)
    rows = docs.select("doc_id", F.call_function("letter_vector", F.col("text")).alias("unit"), bits.alias("bit_string"))
    return rows.select("doc_id", "bit_string", F.round(F.get("unit", F.lit(0)), 6).alias("of_a"), F.round(F.get("unit", F.lit(4)), 6).alias("of_e"))


@query
def embed_benchmark(spark, folder):
    rows = vectors.embed(table(spark, folder, "benchmark"), ENCODER, "text", "embedding")
    cells = rows.select("item_id", F.posexplode("embedding").alias("pos", "x"))
    return cells.select("item_id", "pos", F.round("x", 6).alias("x"))


@query
def filter_bits(spark, folder):
    filters = _benchmark_filters(spark, folder)
    return filters.select("ord", "category", "dim", B.bit_string(F.col("bits"), ENCODER.dim).alias("bit_string"))


@query
def trim_documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    matches = trim_against(docs, _benchmark_filters(spark, folder), ENCODER, SIMILARITY_THRESHOLD)
    return _match_columns(matches, "doc_id")


@query
def trim_conversations(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.col("text").alias("content"))
    matches = trim_against(turns, _benchmark_filters(spark, folder), ENCODER, SIMILARITY_THRESHOLD)
    return _match_columns(matches, "conv_id", "turn")


@query
def trimmed_lines(spark, folder):
    """Result lines: normalised documents, trimmed and rendered."""
    docs = table(spark, folder, "documents").select(F.col("source").alias("filename"), "text")
    rows = docs.select("filename", T.normalize_text(F.col("text")).alias("content"))
    matches = trim_against(rows, _benchmark_filters(spark, folder), ENCODER, SIMILARITY_THRESHOLD)
    return sinks.result_lines(matches)
