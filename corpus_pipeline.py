"""A corpus pipeline of the text operators: each stage takes documents and, but for the last, returns documents.

Rows whose language is rejected go; of a group of linked documents one stays;
documents that hold a benchmark item go; secrets are struck out of the texts;
what is left is mixed to target weights.

All stages read whole texts, however long, keep columns of any other name as they
are (but for the last, which returns the mix), and give no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wingtally.llm import decontamination, jaccard, language, mixing, secrets


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those whose language the calibrated model rejects.

    Null, empty and letterless texts have no language and go, as all do where no row has a label to learn from. Repeated rows get the same answer each; a score at the threshold stays."""
    model = language.train(language.sample(docs, ~language.held_out(), language.PER_LABEL))
    names = tuple(_free(docs, n) for n in ("language", "score", "rejected"))
    return language.identify(docs, model, names=names).where(~F.col(names[2])).select(docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the least doc_id. Documents without words stay.

    Equal rows become one. Different texts of one doc_id, or without a doc_id, stay where nothing with a smaller doc_id links to them."""
    found = jaccard.similar_sets(docs)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept"), "text_hash").distinct()
    text = _free(docs, "text_hash_")
    rows = docs.withColumn(text, F.xxhash64("text"))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["kept"]) & (rows[text] == kept["text_hash"]), "left_semi")
    return rows.dropDuplicates(["doc_id", text]).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; so does every document where the benchmark is empty. Repeated rows go or stay together; a distance of just the budget counts as held."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def strike_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark.

    Null and empty texts stay as they are. Spans that overlap are struck out as one. Repeated rows are changed alike, and none is dropped."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and the words that the mix takes.

    Null and empty texts have size 0 and are never taken; a null source is one of its own, a null doc_id is mixed like any other. Repeated rows are mixed each, in the order of a hash."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language), ("jaccard_join", join_near_copies), ("decontamination", decontaminate), ("secret_scan", strike_secrets), ("source_mix", mix_sources),
]

#: Models and edit distances have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wingtally.llm.shared import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
