"""Registered queries and the pipeline on the smallest tables."""

import re

import duckdb
import pytest

import corpus_pipeline
from sheetloom.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect
from tests.llm.test_operators import brute_hits, lower

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, con):
    assert not compare(QUERIES[name](spark, FOLDER), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_document(name, spark):
    found = QUERIES[name](spark, FOLDER)
    ids = [r.doc_id for r in found.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_held_out_languages(spark):
    found = QUERIES["op8_language"](spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    both = found.join(truth, "doc_id")
    assert both.where("lang = lang_pred").count() >= 0.97 * both.count()


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    total = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
    left = docs.count()
    assert 0.7 * total < left < total
    assert corpus_pipeline.run(spark, FOLDER).where("round_trip").count() == left


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def grams(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_of_similar(rows):
    """Smallest id of every group of texts at similarity 0.8 or more."""
    rows = sorted(rows)
    sets = [grams(t) for _, t in rows]
    near = [[j for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)] for a in sets]
    label = list(range(len(rows)))
    while (new := [min(label[j] for j in n) for n in near]) != label:
        label = new
    return {rows[k][0] for k in label}


def deduplicated(rows):
    """Later copies of runs of two lines, and of single lines of over 50 words, are deleted."""
    order = sorted(rows, key=lambda r: r[0])
    first, gone = {}, {i: set() for i, _ in order}
    for i, t in order:
        lines = (t or "").split("\n")
        for k in range(len(lines)):
            for run in (1, 2):
                key = tuple(lines[k : k + run])
                if len(key) == run and (run == 2 or len(re.findall(r"\S+", lines[k])) > 50) and first.setdefault(key, (i, k)) != (i, k):
                    gone[i] |= set(range(k, k + run))
    out = {(i, t if not gone[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in order}
    return {(i, t) for i, t in out if not gone[i] or t.strip()}


def test_stages_against_brute_force(spark):
    """Every stage judged on its own input, with small operators of its own; columns of clashing names keep their values."""
    stages = dict(corpus_pipeline.STAGES)
    clash = "score lang_pred accepted n_lines runs n_words hit_spans hit_items digest prefix root vertex __id __key __k1 __runs __lines __in2"
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("*", *(f"concat('{c} of ', doc_id) AS {c}" for c in clash.split()), "doc_id AS `dotted.name`")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    before = {r.doc_id: r.asDict() for r in docs.collect()}

    def run(name):
        found = stages[name](spark, docs, FOLDER)
        assert found.columns == docs.columns
        found = found.collect()
        for r in found:
            left = {k: v for k, v in r.asDict().items() if k not in ("text", "n_chars")}
            assert left == {k: before[r.doc_id][k] for k in left}, name
            assert r.n_chars == (before[r.doc_id]["n_chars"] if r.text == before[r.doc_id]["text"] else len(r.text))
        return {(r.doc_id, r.text) for r in found}

    assert len(run("language")) > 150
    assert run("line_dedup") == deduplicated(rows)
    assert {i for i, _ in run("near_duplicates")} == kept_of_similar(rows)
    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    assert {i for i, _ in run("decontamination")} == {i for i, t in rows if brute_hits(t, items)[1] == 0}
