"""A corpus made ready for training: five stages over the documents table, each one of the operators of storyline.llm.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last give the columns of documents. Documents under the quality threshold go, one document of
each class of near-duplicates stays (five-word shingles, similarity 0.8), documents that hold benchmark passages go,
personal data in texts are replaced, and what is left is encoded; the text of the last stage is what its ids spell.

Columns of any other name pass through all stages; only the last one replaces `ids` and `n_tokens`. Null texts count as
empty: they are scored like empty ones, stay null up to the last stage, and come out of it as empty texts without ids.
Rows with a null id are told apart by their texts, and one text under several ids is one document to the join, which
keeps the smallest id (a null id last) and a repeated row once. Empty texts are near-duplicates of nothing but rows of the
same id. Texts are taken whole, however long. Empty documents give no rows. Without labels every document scores 0.5 and
stays; without a benchmark every document stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm import bpe, decontaminate, pii, quality, similar
from storyline.llm.common import materialize, table
from storyline.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.one_of_each(docs, 5, 80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs, tokenizer_path(), out="ids").drop("text")
    return bpe.decode(coded, tokenizer_path(), out="text").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", drop_benchmark),
    ("PII", replace_personal_data),
    ("BPE encoding and decoding", encode),
]
#: SQL can express neither the classifier nor the classes of linked documents; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
