"""Components of near documents hold all copies, those of the same hash too."""

import duckdb
import pytest

from storyline.plans import queries as library

TEXT = "the quick brown fox jumps over the lazy dog while nine other animals watch from a distance and wait for rain"
#: doc_id, text: two with the same words of which the second is longer, a lone pair of equal ones, one alone, two without words.
DOCS = [(1, TEXT), (2, TEXT + "   " + TEXT), (3, "wholly different words stand here"), (7, "a pair apart"), (8, "a pair apart"), (9, TEXT.replace("while", "While")), (10, ""), (11, None)]


@pytest.fixture()
def at(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in DOCS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize(("name", "want"), [("near_dup_components", {(1, 1), (2, 1), (9, 1), (7, 7), (8, 7)}), ("best_copy", {(1, 2, len(DOCS[1][1])), (7, 7, 12)})])
def test_documents_of_the_same_hash_are_members(spark, at, name, want):
    """Only the first document of each hash was a node, so that a lone set of equal hashes had no component at all."""
    df = library.QUERIES[name](spark, at)
    assert {tuple(r) for r in df.collect()} == want
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    rel = c.execute(library.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert {tuple(r[names.index(k)] for k in df.columns) for r in rel.fetchall()} == want


def test_the_best_copy_may_be_a_later_one_of_its_hash(spark, at):
    """The longest document was no candidate if another one of its hash had a smaller id."""
    assert {r.best: r.n_chars for r in library.best_copy(spark, at).collect()}[2] == len(TEXT) * 2 + 3
