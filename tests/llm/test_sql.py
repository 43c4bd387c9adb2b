import duckdb
import pytest

from storyline.llm import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.execute(q.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(r[names.index(c)] for c in cols) for r in rel.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want
