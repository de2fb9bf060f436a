"""From raw documents to packed training sequences; part of ``tidefold.llm``.

Each stage takes (spark, docs, sf_dir) and gives a table; ``run`` writes each to the shared folder and reads it back as the
next one's documents. All but the last keep the columns of documents; ``n_chars`` follows the text.

Null and empty texts go with the quality rules. Rows with a null id are judged and deduplicated like others, keep passages that others have, and are packed.
Repeated rows and copies leave one row; ties go by the least id. A text may have any length. Other columns come through the first three stages as they are,
whatever their names. Without documents there are no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import packing, quality, simhash, suffix_dedup
from tidefold.llm.common import stored
from tidefold.llm.queries import packed


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


#: A short text is no fault of its own: operator 9's query asks for 50 words, the corpus keeps what is clean.
RULES = quality.Rules(min_words=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from every text, and rejected documents go."""
    return _counted(quality.clean(docs, "text", RULES))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays. Operator 10's fingerprints link, and so do texts whose five-word
    shingles have a similarity of 0.8 or more, most of which fingerprints do not reach."""
    return simhash.keep_one(docs, "doc_id", "text", resembling=True)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they are first found."""
    return _counted(suffix_dedup.remove_repeats(docs, "doc_id", "text"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens in sequences of at most 4096."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), packing, stored)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", best_fit),
]

#: Fingerprints, hashed suffixes and BPE ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
