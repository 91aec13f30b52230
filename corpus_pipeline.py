"""A corpus pipeline: toxic documents go, one of each group of near copies stays, benchmark leaks go, secrets are redacted, texts are encoded.

Cases, for every stage: null and empty texts pass it as they are (and have no tokens); a null id is an id like any other; very long texts
are looked at whole; further columns pass, also such as are named like internal ones; an empty table gives an empty table of the same
columns. What a stage does with equal rows stands with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, settle
from tidemark.llm.op1_toxicity import drop_toxic, learn
from tidemark.llm.op3_bpe import encode_documents
from tidemark.llm.op4_decontamination import drop_leaks
from tidemark.llm.op5_near_dedup import one_of_each
from tidemark.llm.op9_secret_scans import redact

#: SQL can express neither the learned lexicon nor the later stages; tests hold them against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled rows among docs, does not reject. Equal rows go or stay together; without labels none goes."""
    return drop_toxic(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more: that of the smallest id.

    Of equal rows one stays. Rows without words are near copies of nothing, so all of them stay.
    """
    return one_of_each(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Equal rows go or stay together; with an empty benchmark none goes."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets redacted, and n_chars counted anew where something was. Equal rows stay equal."""
    return redact(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids of all documents, their number, and the digests of ids and decoded text. Equal rows are encoded alike."""
    import public_tokenizers

    out = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written as Parquet in the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
