"""The queries opN_<name> and pipeline, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm import align, audit, bpe, decontaminate, html, licences, lm, neighbours, pii, quality, secrets, shards, similar
from storyline.llm import spans as S
from storyline.llm.common import table, texts

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    both = bpe.decode(bpe.encode(docs, tokenizer_path()).drop("text"), tokenizer_path())
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(S.count_of(F.col("spans"), k).alias(f"n_{k}") for k in kinds),
        F.sha2(S.joined(base), 256).alias("base_sha256"),
        S.joined(F.col("spans")).alias("spans"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(pii.find(table(spark, sf_dir, "documents")), pii.KINDS)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(secrets.find(table(spark, sf_dir, "documents")), secrets.KINDS)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lm.held_out(F.col("doc_id"))
    scored = lm.score(docs, docs.filter(~out))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.classes(table(spark, sf_dir, "documents"), 4, 85).drop("text_hash")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shards.assign(table(spark, sf_dir, "documents"), 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = html.extract(table(spark, sf_dir, "pages"))
    return said.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = licences.scan(table(spark, sf_dir, "documents"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return told.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.concat("base.label", "spans.label")).alias("labels"),
        # A phrase is a template that is covered whole.
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
    )


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = align.score(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECE_BPE))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_secrets": op3_secrets,
    "op4_lm": op4_lm,
    "op5_ngram_join": op5_ngram_join,
    "op6_decontaminate": op6_decontaminate,
    "op7_shards": op7_shards,
    "op8_quality": op8_quality,
    "op9_html": op9_html,
    "op10_neighbours": op10_neighbours,
    "op11_licences": op11_licences,
    "op12_align": op12_align,
    "op13_audit": op13_audit,
}
ORACLE: dict[str, str] = {
    # Links from shared shingles, classes by what can be reached; for tables whose doc_id are present and differ.
    "op5_ngram_join": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM split),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles AS a JOIN shingles AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reached AS r JOIN links AS l ON r.other = l.a)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, least AS component_id
FROM sets JOIN (SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id) AS m ON sets.doc_id = m.doc_id""",
    # The exact search, against which the tree's is approximate.
    "op10_neighbours": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= 5""",
}
ORACLE["op13_audit"] = r"""
WITH split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failed AS (
  SELECT doc_id, part,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM split),
known AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
counters AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, mask),
letters AS (SELECT 'A' AS f UNION ALL SELECT 'B' UNION ALL SELECT 'C' UNION ALL SELECT 'D' UNION ALL SELECT 'E'),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, s::INTEGER AS step, 1 << (ascii(filter_order[s]) - 65) AS bit,
    coalesce(list_sum([1 << (ascii(filter_order[i]) - 65) FOR i IN range(1, s)]), 0)::INT AS before
  FROM orders, range(1, 6) AS r(s)),
counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM counters, steps GROUP BY part, filter_order, step, bit)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM counted"""
