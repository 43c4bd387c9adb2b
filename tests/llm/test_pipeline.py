import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storyline.llm import queries as q
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    at = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        at.append({r.doc_id: r for r in docs.collect()})
        assert k == 4 or docs.columns == columns
    good = [i for i, y in labels.items() if y]
    assert sum(i in at[0] for i in good) >= 0.95 * len(good)
    rows = [(i, texts[i]) for i in at[0]]
    assert set(at[1]) == {c for _, c in brute.classes(rows, 5, 80)}
    assert set(at[2]) == {i for i in at[1] if not any(b in texts[i] for b in items)}
    for i, r in at[3].items():
        assert not brute.spans(r.text, brute.PII) or "[" in r.text
        if not brute.spans(texts[i], brute.PII):
            assert r.text == texts[i]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.tokenizer_path())
    for i, r in at[4].items():
        assert list(r.ids) == t.encode(at[3][i].text, add_special_tokens=False).ids and r.text == at[3][i].text


#: Names that the operators use for columns of their own.
CLASHING = "score _score _hash _h _id _th _spans text_hash component_id root node n ids spans label y stats hits doc pos hash decoded".split()
LONG = "one long text goes on " * 20000


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empty, long and repeated texts, repeated rows, and columns of clashing names."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    mail = "write to Some.One@example.org today about the " + "quiet garden behind the old mill " * 9
    more = [(None, None), (None, ""), (None, mail), (900, None), (901, ""), (902, LONG), (903, LONG), (904, f"before {item} after"), (905, mail), (905, mail), (905, "another text of the same id"), (None, "x")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in more], docs.schema))
    return docs.select("*", *(F.concat_ws(":", F.lit(c), F.col("doc_id")).alias(c) for c in CLASHING))


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, odd, tmp_path, k):
    name, stage = corpus_pipeline.STAGES[k]
    odd.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    before = docs.collect()
    stage(spark, docs, DATA).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    after = got.collect()
    if k < 4:
        assert got.columns == docs.columns
    for r in after:
        for c in CLASHING:
            if not (k == 4 and c == "ids"):
                assert r[c] == (c if r.doc_id is None else f"{c}:{r.doc_id}")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")
    pairs = lambda rows: collections.Counter(map(key, rows))
    if k == 0:  # labels are of the table's own documents; a row stays or goes, none is made or changed
        assert not pairs(after) - pairs(before)
        good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").collect()}
        assert len(good & {r.doc_id for r in after}) >= 0.95 * len(good)
    if k == 1:
        filled = [(j, r) for j, r in enumerate(sorted(before, key=key)) if (r.text or "").split()]
        named = brute.classes([(j, r.text) for j, r in filled], 5, 80)
        heads = collections.Counter(key(r) for (j, r), (_, c) in zip(filled, named, strict=True) if j == c)
        assert collections.Counter(key(r) for r in after if (r.text or "").split()) == heads
        # Null and empty texts are one: one row for each id.
        assert sorted(str(r.doc_id) for r in after if not (r.text or "").split()) == ["900", "901", "None"]
    if k == 2:
        items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
        assert pairs(after) == pairs(r for r in before if not any(b in (r.text or "") for b in items))
    if k == 3:
        assert len(after) == len(before)
        assert collections.Counter(r.doc_id for r in after) == collections.Counter(r.doc_id for r in before)
        said = [r for r in after if r.text and "[EMAIL] today" in r.text]
        assert len(said) == 3 and all(r.n_chars == len(r.text) for r in said)
        assert sum(r.text is None for r in after) == 2
        clean = [r for r in before if not brute.spans(r.text or "", brute.PII)]
        assert not pairs(clean) - pairs(after)
    if k == 4:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(q.tokenizer_path())
        assert pairs(after) == collections.Counter((*key(r)[:2], False, r.text or "") for r in before)
        for r in after:
            assert list(r.ids) == t.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_stages_on_empty_tables(spark, odd, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    odd.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nothing_to_learn_or_to_look_for_keeps_all_rows(spark, odd, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for k in (0, 2):
        assert corpus_pipeline.STAGES[k][1](spark, odd, str(tmp_path)).count() == odd.count()
