import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    import corpus_pipeline as p

    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF).persist()
        assert out.columns == first.columns, name
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
    rows = p.STAGES[-1][1](spark, docs, SF).collect()
    assert len(rows) == docs.count()
    again = p.run(spark, SF).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_stages_take_odd_tables(spark, odd, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in p.STAGES:
        for df in (odd, odd.limit(0)):
            out = stage(spark, df, str(tmp_path))
            assert name == "mixing" or out.columns == odd.columns
            out.collect()


@pytest.mark.parametrize("name", ["op8_decontaminate", "op6_neardup", "op10_toolcalls"])
def test_against_sql(spark, name):
    import duckdb

    from barloom.llm import queries

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    rel = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == sorted(map(str, rel.fetchall()))
