"""From raw documents to token ids, in stages that are each written and read again.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
documents; what a stage rejects or changes is so for all later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import bpe, decontaminate, minhash, pii, toxicity
from siftstone.llm.common import documents, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar scores below one half.

    Null and empty texts have no clause and stay; null ids and repeated rows are
    scored like any other; columns may have any name; an empty table stays empty.
    Labels only teach: a document is judged by its text.
    """
    model = toxicity.fit(docs, toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, on shingles of five words and a similarity of 0.8.

    The least doc_id of a class stays, a null id only where there is no other;
    rows equal in id and text are one; different texts under one id all stay.
    Null and empty texts are no duplicates of each other and stay, once for each
    id; columns may have any name; an empty table stays empty.
    """
    return minhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Null and empty texts leak nothing and stay, and null or empty items are
    never leaked; null ids and repeated rows are judged like any other; columns
    may have any name; without items or documents nothing changes.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it replaced; n_chars follows the text.

    Null texts stay null, with n_chars null, and empty ones empty; null ids and
    repeated rows are kept; columns may have any name; an empty table stays empty.
    """
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document.

    Null and empty texts have no ids; null ids and repeated rows each return a
    row; other columns are left out; an empty table stays empty.
    """
    return bpe.encode_arrays(docs, *bpe.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", sanitise),
    ("byte_bpe", encode),
]

#: The stages learn models and search by hashing, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
