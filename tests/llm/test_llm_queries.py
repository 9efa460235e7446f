"""Registered queries against their SQL, and the pipeline against its stages' rules."""

import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from docketlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(map(str, result.fetchall()))
    assert want == sorted(str(tuple(r)) for r in got.select(*names).collect())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_pipeline(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in out}
    good = [k for k, q in labels.items() if q == 1]
    assert len(ids) == len(out) and all(r.round_trip for r in out)
    assert ids < {r.doc_id for r in documents.collect()}
    assert sum(k in ids for k in good) > 0.7 * len(good)
    assert sum(k in ids for k, q in labels.items() if q == 0) <= 0.5 * sum(q == 0 for q in labels.values())


def test_pipeline_keeps_one_of_repeated_rows(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    long = [" ".join(word() for _ in range(120)) for _ in range(6)]
    rows = [(1, long[0]), (1, long[0]), (None, long[1]), (None, long[1]), (None, long[1] + " end"), (2, long[2]), (2, long[3]),
            (None, long[4]), (9, long[4]), (3, long[5]), (None, None), (None, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.one_of_each_group(spark, docs, SF)
    want = sorted([(1, long[0]), (2, long[2]), (2, long[3]), (9, long[4]), (3, long[5]), (None, None), (4, "")], key=str)
    got = sorted(((x.doc_id, x.text) for x in one.collect()), key=str)
    assert [x for x in got if x not in want] in ([(None, long[1])], [(None, long[1] + " end")])
    assert [x for x in got if x in want] == want and len(got) == len(want) + 1
    assert one.columns == docs.columns
    kept = corpus_pipeline.unrepeated_text(spark, one, SF)
    # A missing text leaves this stage as an empty one.
    assert Counter((x.doc_id, x.text) for x in kept.collect()) == Counter((k, t or "") for k, t in got)
