"""A training-data pipeline over ``documents``: quality, language, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of ``documents``. The driver writes each stage's result and reads it again as the
next one's docs; run() does the same through the shared folder.

Defined results of all stages: an empty table gives an empty table. Columns beyond those of ``documents`` are
not read, so none can clash. Rows with a null doc_id are judged by their texts like all others, are never
dropped as copies and never make others copies. Rows repeated with one id and text become one in near-dedup;
rows of one id with different texts are documents of their own. Texts of any length are read whole. Null and
empty texts fail the quality rules, and texts without a letter fail the language stage at the latest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomery.llm import alike, langid, packing, quality, substring
from loomery.llm.queries import vocabulary
from loomery.llm.sparkutil import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Language scores below this are rejected; clean texts of a learned language score far above it.
LEAST_LANG_SCORE = 0.4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie too far from every language reference.

    References are counted over all of docs. Equal texts get equal verdicts; without a reference only the
    base rules hold.
    """
    docs = docs.select(*COLUMNS)
    return quality.judge(docs, quality.fit(docs)).where("kept").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that no learned language fits.

    Learns from the labelled rows of docs (null labels teach nothing); without any, nothing is dropped.
    """
    docs = docs.select(*COLUMNS)
    net = langid.fit(docs)
    if net is None:
        return docs
    return langid.predict(docs, net).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANG_SCORE)).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group alike by 0.8 or more in five-word shingles, counted exactly.

    Fingerprints go through the deletion variants of op3 first; what these propose is counted over all shingles. At 0.8,
    64-bit fingerprints differ in some ten bits, more than one-wildcard segments find, so prefixes of the sets find all that
    is alike beyond them (README). Ties go to the smallest id; all texts without words are alike.
    """
    return alike.keep_one(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 or more words that a document with a smaller id has too.

    A document that loses words is joined by single spaces, and n_chars counted anew; others stay as they are.
    """
    out = substring.remove_repeats(docs.select(*COLUMNS))
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens: a row a piece. An empty text is its end token alone."""
    return packing.pack(packing.encoded(docs, vocabulary("byte_bpe_50k.json")), digests=True)


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # models, fingerprints and packing have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
