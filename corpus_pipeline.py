"""From raw documents to packed sequences, in four stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and reads it
again as the next stage's docs. All but the last return the columns of documents:

1. ``quality_rules`` drops the documents that the policy full-2 rejects.
2. ``simhash`` keeps one document of each group of near-duplicates (0.8 or more of their five-word shingles in common), that of the
   smallest doc_id.
3. ``suffix_dedup`` cuts out of the texts every string of 400 bytes, and every passage of more than 50 words, that is left more than
   once, all its places.
4. ``packing`` packs the ids of what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopy.llm import packing, quality, simhash, suffix_dedup
from canopy.llm.queries import table, tokenizer_file
from canopy.llm.scratch import Steps

POLICY = "full-2"
TOKENIZER = "word_bpe_49k.json"
PASSAGE_WORDS = 51
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the policy passes, as they are; null and empty texts have no words and go; repeated rows are judged each on its own."""
    return quality.filter_documents(docs, POLICY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest doc_id (a null one only where there is no other); of rows equal in doc_id and text, one stays."""
    return simhash.keep_first(docs, SHINGLE_WORDS, SIMILARITY)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with what their texts hold alone; a text of which nothing is left is empty, a null text stays null."""
    return suffix_dedup.remove_repeats(docs, words=PASSAGE_WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents; a null or empty text is its end id alone, repeated rows are packed each on its own."""
    return packing.pack(docs, tokenizer_file(TOKENIZER))


STAGES = [("quality_rules", quality_rules), ("simhash", near_duplicates), ("suffix_dedup", repeated_strings), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage packs from the documents of sf_dir."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        steps = Steps(spark)
        docs = steps.saved(stage(spark, docs, sf_dir), name)
        if before:
            before.clear()  # the stage that read it is written
        before = steps
    return docs


#: Packing and the two dedup stages cannot be expressed in SQL; tests compare run() with brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
