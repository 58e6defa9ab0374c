import os


import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tabulon.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_thirteen_operators_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(ORACLES) <= set(QUERIES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "mixing", "packing"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_pipeline_stages(spark):
    rows = [(i, f"alpha beta gamma delta word{i} word{i + 1} word{i * 7 % 90} omega", "en", "s", i) for i in range(60)]
    rows += [(100 + i, "one text that comes again and again in many copies", "en", "s", 0) for i in range(5)]
    rows += [(200, None, None, None, None), (None, "no id at all in this row", "en", "s", 1), (201, "", "en", "s", 0), (5, rows[5][1], "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, kept string, copies long")
    after = {}
    d = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        d = stage(spark, d, SF)
        assert d.columns == docs.columns
        d = d.checkpoint()
        after[name] = d.toPandas()
    clean = after["toxicity"]
    assert len(clean) >= len(rows) - 2
    left = after["near_copies"]
    assert (left.doc_id == 100).sum() == 1 and not left.doc_id.isin([101, 102, 103, 104]).any()
    assert (left.doc_id == 5).sum() == 1 and left.doc_id.isna().sum() == 1 and (left.doc_id == 200).sum() == 1 and (left.doc_id == 201).sum() == 1
    packed = corpus_pipeline.STAGES[3][1](spark, d, SF)
    assert packed.count() >= len(after["mixing"])
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_intermediate_folder_is_the_shared_one(spark):
    assert spark.conf.get("spark.checkpoint.dir") and os.path.isabs(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
