"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, license, mixing, packing, paragraphs, quality, runs, search, simhash, token_files, toxicity, whitening

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query
def op1_simhash(spark, folder):
    return simhash.near_duplicates(documents(spark, folder))


@query
def op2_token_files(spark, folder):
    return token_files.written_and_read(documents(spark, folder))


@query
def op3_quality(spark, folder):
    return quality.judge(documents(spark, folder))


@query
def op5_bpe(spark, folder):
    return bpe.digests(documents(spark, folder))


@query
def op7_packing(spark, folder):
    return packing.pack(documents(spark, folder))


@query
def op8_toxicity(spark, folder):
    return toxicity.score(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query
def op10_paragraphs(spark, folder):
    return paragraphs.repeated_passages(documents(spark, folder))


@query
def op4_ctw(spark, folder):
    return ctw.score(documents(spark, folder))


@query
def op9_search(spark, folder):
    docs = documents(spark, folder)
    queries = docs.where("doc_id % 50 = 0").selectExpr("doc_id as query_id", "text")
    return search.search(docs, queries, k=10)


@query
def op6_license(spark, folder):
    """Documents as files of a tree: source / thousand / hundred, whose first one is the directory's LICENSE."""
    name = F.expr("if(doc_id % 100 = 0, 'LICENSE', concat(doc_id, '.txt'))")
    path = F.concat_ws("/", F.col("source"), F.expr("cast(doc_id div 1000 as string)"), F.expr("cast(doc_id div 100 as string)"), name)
    files = documents(spark, folder).select("doc_id", path.alias("path"), "text")
    return license.scan(files)


@query
def op11_whitening(spark, folder):
    return whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query
def op12_mixing(spark, folder):
    return mixing.taken(documents(spark, folder))


@query
def op13_runs(spark, folder):
    return runs.digests(documents(spark, folder))
