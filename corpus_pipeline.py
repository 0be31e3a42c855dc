"""A training-data pipeline: language ID, near-dedup, decontamination, PII, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but
the last return the columns of ``documents``, further ones and names that operators use
inside included; the last returns the encoded documents.  An empty table passes through all
stages as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import decontaminate, language_id, near_dup, pii, sentencepiece_fst
from routeloom.llm.common import drop_folder, shared_folder, table

#: Similarity of word shingles from which the pipeline drops near copies, in hundredths (op8's contract has 85).
NEAR = 80
#: Setting of the session that holds the key of the pseudonyms; without it the public demonstration key is taken, which protects nothing.
KEY_SETTING = "spark.routeloom.pii.key"
#: Columns of the stages' own, which no input has.
MATCHES, COUNTS = "__pipeline_bench_matches", "__pipeline_pii_counts"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told without doubt; null texts and texts without a letter go, and all go if no row has a language to learn from."""
    return language_id.keep_known(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; rows without an id and texts without words stay, rows that repeat the id that stays do too."""
    return near_dup.deduplicate(docs, NEAR)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; null and empty texts hold none."""
    matched = decontaminate.with_matches(docs, table(spark, sf_dir, "benchmark"), name=MATCHES)
    return matched.where(F.size(MATCHES) == 0).select(*[f"`{c}`" for c in docs.columns])


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms; null texts stay null."""
    key = spark.conf.get(KEY_SETTING, None)
    return pii.pseudonymise(docs, key.encode() if key else pii.DEMO_KEY, counts_as=COUNTS).select(*[f"`{c}`" for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, n_fallback, ids and round_trip of every document; null and empty texts have no pieces."""
    import public_tokenizers

    return sentencepiece_fst.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("pii", replace_personal_data),
    ("sentencepiece", encode_pieces),
]
#: The stages are models, sketches and transducers: SQL can't express them; the tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again, and removed once the next one is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                drop_folder(spark, before)
            before = path
    return docs
