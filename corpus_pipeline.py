"""The corpus pipeline: quality rules, toxicity, near duplicates, secrets and packing, stage by stage.

Every stage takes whole tables of documents and treats odd rows alike: a null text counts as empty, null ids, languages
and sources are kept as they are, repeated rows are rows of their own, an empty table gives an empty one, and further
columns, whatever their names, play no part and are left behind. Texts of any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewire.llm.common import Scratch, materialise, shared_dir, table
from tidewire.llm.near import near_duplicates
from tidewire.llm.packing import pack
from tidewire.llm.quality import quality_rules
from tidewire.llm.secrets import redacted, scan
from tidewire.llm.toxicity import toxicity, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rules and isolation forest find nothing amiss. Empty and null texts have too few words, and go.

    Repeated rows get one verdict. The forest is that of all rows of `docs`; labels count, all of them, as far as their
    documents are among `docs`.
    """
    judged = quality_rules(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return judged.where("kept").select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. An empty text stays; repeated rows get one verdict.

    Labels count as far as their documents are among `docs`; without labels of both kinds nothing is called toxic.
    """
    scored = toxicity(docs, train(docs, table(spark, sf_dir, "labels")), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the one with the least id, or any where none has an id.

    Repeated rows, and texts without words (nulls too), are copies of one another; unlike texts under one id both stay.
    """
    numbered = materialise(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")), shared_dir(spark))
    kept = near_duplicates(numbered, row="__row").where("stays").select("__row")
    return numbered.join(kept, "__row", "left_semi").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark, and their lengths as they then are; all rows stay, a null text as null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = scan(docs).withColumn("text", F.when(F.size("all_spans") > 0, redacted(text, F.col("all_spans"))).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.when(F.size("all_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 2048 tokens; an empty text is its end token alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("toxicity", clean),
    ("n-gram Jaccard join", distinct),
    ("secret scans", redact),
    ("packing", packed),
]

#: The classifiers and the tokenizer are beyond SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each stage's rows are written and read again as the next one's.

    A stage's table is emptied once the next stage's is written; the last one stays, as the lazy result reads it.
    """
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop_all_but(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
