import os

import duckdb
import pandas as pd
import pytest

from spanvec.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def table(df: pd.DataFrame) -> list[str]:
    cols = sorted(df.columns)
    return sorted("|".join("null" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name not in catalog.oracle_sql():
        assert name == "kmeans_train" and got.n.sum() == 500
        return
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # kinds as a schema check sees them
        assert got[c].dtype.kind == want[c].dtype.kind or {got[c].dtype.kind, want[c].dtype.kind} <= set("if"), (c, got[c].dtype, want[c].dtype)
    assert table(got.astype({c: float for c in got.columns if "f" in got[c].dtype.kind + want[c].dtype.kind})) == table(want.astype({c: float for c in got.columns if "f" in got[c].dtype.kind + want[c].dtype.kind}))
    assert len(got)


def test_versions_hold_every_vector_and_the_join_every_document(spark):
    q = catalog.queries()
    ids = lambda name: {r.id for r in q[name](spark, SF).collect()}
    every = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    live = {i for i in every if i % 17}
    assert ids("rebase_all") == live > ids("rebase") and ids("tombstone_filter_all") == live
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert all((r.n_chars is not None) == (r.id in docs) for r in q["meta_left_join_all"](spark, SF).collect())


def test_an_index_query_has_its_recall(spark):
    hits = lambda name: {(r.qid, r.id) for r in catalog.queries()[name](spark, SF).collect()}
    exact = hits("exact_topk")
    assert len(hits("ivf_topk_recall90") & exact) >= 0.9 * len(exact)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 100
    assert set(e.oracle_sql()) <= set(e.queries())
