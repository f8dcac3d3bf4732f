"""The corpus pipeline: language identification, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm.common import drop_folder, dropping, new_folder, table
from quire.llm.jaccard import one_of_each
from quire.llm.language import fit, identify
from quire.llm.mixing import mix
from quire.llm.packing import WORD_BPE, WORD_BPE_END, pack_sequences


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told.

    The classifier learns from the labelled documents among docs. Documents whose text is
    null, has no letter or is as near to two languages go; a null lang is filled in.
    """
    found = identify(docs, fit(docs), docs.columns, "__found_").where("__found_accepted")
    return found.withColumn("lang", F.coalesce("lang", "__found_lang_pred")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near duplicates (five-word shingles, 0.8) the document with the smallest id, and one row of it."""
    return one_of_each(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at weights 5, 2, 1 in turn: documents are left out, kept or repeated up to three times.

    Null and blank texts have no words and are left out; a null source is a source; repeated rows are documents of their own. An empty table stays empty.
    """
    return mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4,096 ids along the curve: their pieces, with checksums.

    Null text is empty: its closing id alone. Repeated rows, and the mix's copies, are documents of their own, in different sequences. An empty table has no pieces.
    """
    import public_tokenizers

    pieces = pack_sequences(docs, public_tokenizers.path(WORD_BPE), WORD_BPE_END)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Dictionaries, byte-pair vocabularies and curve order can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents of sf_dir, each written to the shared folder and read again.

    A stage's rows are deleted once the next stage's are written, and the tables it made on
    its way once its own are; those before the last stage, and what that one makes, stay until the session's process ends, for the result is read from them.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        with dropping(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
