"""The inverted index against a scan, and what a search reads of it."""

import math
import re
from collections import Counter

import pytest
from marketloom.operators import text_index
from marketloom.operators.extraction import chunks


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "the the rare-word-x")], "doc_id long, text string"))
    path = str(tmp_path_factory.mktemp("index"))
    text_index.write_index(docs, path, 16)
    return path, [(r.doc_id, r.chunk_index, r.content.lower().split(" ")) for r in chunks(docs).collect()]


def scan(rows, terms, k):
    df = {t: sum(t in w for _, _, w in rows) for t in terms}
    found = []
    for i, c, words in rows:
        n = Counter(words)
        if all(n[t] for t in terms):
            score = sum(n[t] / len(words) * math.log(len(rows) / df[t]) for t in terms)
            found.append((-math.floor(score * 1e6 + 0.5) / 1e6, i, c))
    return [(i, c, -s) for s, i, c in sorted(found)[:k]]


@pytest.mark.parametrize("terms", [("the",), ("the", "of", "and"), ("rare-word-x", "the"), ("the", "the"), ("absent-word",), ("of", "absent-word")])
def test_equals_a_scan(spark, index, terms):
    path, rows = index
    assert [tuple(r) for r in text_index.search_index(spark, path, terms, 15).collect()] == scan(rows, tuple(dict.fromkeys(terms)), 15)


def test_words_are_counted_before_any_shuffle(spark, index):
    docs = spark.createDataFrame([(1, "a B a\tb c " + "d " * 400), (2, None), (3, " "), (4, "É é a")], "doc_id long, text string")
    rows = text_index.postings(docs)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString().replace("ExistingRDD", "")
    whole = chunks(docs).collect()
    told = {(r.doc_id, r.chunk_index, r.term): (r.tf, r.n_words) for r in rows.collect()}
    assert told == {(c.doc_id, c.chunk_index, t): (n, len(c.content.split(" "))) for c in whole for t, n in Counter(c.content.lower().split(" ")).items()}
    twice = {(r.doc_id, r.chunk_index, r.term): r.tf for r in text_index.postings(docs.union(docs)).collect()}  # equal places of a repeated id are one
    assert twice == {k: 2 * n for k, (n, _) in told.items()}
    path, chunked = index
    assert tuple(spark.read.parquet(f"{path}/size").first()) == (len(chunked), 16)


def test_reads_the_buckets_of_its_terms_alone(spark, index):
    path, _ = index
    table = spark.read.parquet(f"{path}/postings")
    rows = text_index.of_terms(table, ("the", "of"), 16)
    assert {re.search(r"bucket=(\d+)", f)[1] for f in rows.select("*").inputFiles()}  # the table has folders by bucket
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    read = rows.select("bucket").distinct().count()
    assert read <= 2 < table.select("bucket").distinct().count()
