"""The corpus pipeline: documents in, token ids out, each stage on all that the one before kept.

Stages write their result as Parquet below the shared folder and the next one reads it, so a lost executor
costs the work of one stage's tasks, never that of earlier stages. What a stage has staged on its way is deleted when
a later stage begins on the written result.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from cohortlens.llm.byte_bpe import encode
from cohortlens.llm.decontaminate import decontaminate
from cohortlens.llm.jaccard_join import first_of_components
from cohortlens.llm.quality import judge
from cohortlens.llm.queries import vocabulary_path
from cohortlens.llm.secrets import new_ledger, redact, scan_versions
from cohortlens.session import collecting, drop_staged, stage

#: Per application: the position of the last stage that was called and the tables it left.
_LEFT: dict[str, tuple[int, list[str]]] = {}


def _cleaning(number: int, work):
    """``work`` as stage ``number``: drops what earlier stages staged, unless ``docs`` still reads from it."""
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        last, paths = _LEFT.get(spark.sparkContext.applicationId, (number, []))
        if last < number and not any(path.rpartition("/")[2] in file for path in paths for file in docs.inputFiles()):
            for path in paths:
                drop_staged(spark, path)
            paths = []
        with collecting() as mine:
            out = work(spark, docs, sf_dir)
        _LEFT[spark.sparkContext.applicationId] = (number, paths + mine)
        return out
    return run_stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive thresholds of their language and source."""
    return judge(docs).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return first_of_components(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("NOT contaminated").select("row.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and ``n_chars`` counted anew."""
    clean = redact(scan_versions(docs, new_ledger(spark)))
    if "n_chars" in clean.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                                 .otherwise(F.length("text").cast(kind)))
    return clean.select(*(f"`{c}`" for c in docs.columns))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns without the text, and its token ids. NULL and empty texts have none; repeated rows are
    encoded each; columns of the documents that are named like a result raise a ValueError."""
    rest = [c for c in docs.columns if c != "text"]
    if taken := {"token_ids", "n_tokens"} & {c.lower() for c in rest}:
        raise ValueError(f"rename the columns {sorted(taken)}: the result has columns of these names")
    coded = encode(docs, vocabulary_path(), public_tokenizers.PATTERN, keep=rest)
    return coded.select("row.*", F.col("ids").alias("token_ids"), F.size("ids").cast("long").alias("n_tokens"))


STAGES = [(name, _cleaning(i, work)) for i, (name, work) in enumerate([
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
])]

#: SQL has no byte-pair merging; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, work in STAGES:
        docs = stage(work(spark, docs, sf_dir))
    return docs
