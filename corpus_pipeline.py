"""A corpus made fit for training: five stages over the table documents.

Each stage takes what its predecessor kept and returns the columns of documents; the last adds the copies that the
mix takes. Stages are written as Parquet and read again, so each runs on its own and a lost one is repeated alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipecheck.llm.common import SPACES, table
from pipecheck.llm.decontamination import contamination
from pipecheck.llm.line_dedup import dedup_lines
from pipecheck.llm.mixing import emitted, mix_sources
from pipecheck.llm.ngram_join import similar_groups
from pipecheck.llm.toxicity import fit_toxicity, score_toxicity
from pipecheck.session import shared_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs.select(*COLUMNS), model).filter("score < 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; n_chars is that of the new text. A text that has or keeps nothing goes."""
    kept = dedup_lines(docs.select(*COLUMNS)).filter(F.btrim("text", F.lit(SPACES)) != "")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies; documents without words stay."""
    others = similar_groups(docs).filter("component_id <> doc_id").select("doc_id")
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id")
    return docs.select(*COLUMNS).join(hit, "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with size, source_size, target, copies (0 for those left out) and taken."""
    return mix_sources(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus itself: the documents of ``run``, each as often as its copies say, with copy from 1 on."""
    return emitted(run(spark, sf_dir))


QUERIES = {"pipeline": (run, ORACLE_SQL), "pipeline_corpus": (corpus, None)}
