"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as
Parquet before the next one reads it. All but the last return the columns of ``documents``.

In every stage: an empty table gives an empty result, whole texts count however long they are, columns besides doc_id,
text, lang and source may have any names and pass through (the last stage leaves them out), and rows are told apart
whatever their ids, which may be repeated or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatracks.llm import language_id, mixing, packing, quality_rules, simhash
from seatracks.llm.common import free_name, table, written
from seatracks.llm.queries import held_out

#: Up to this posterior of the best language a document is rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: A line that stands in more different documents of a host is boilerplate, however large the host is.
MOST_DOCS_OF_A_LINE = 10
#: Jaccard similarity from which two documents are near-duplicates.
LEAST_SIMILARITY = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those whose language is uncertain.

    Null and empty texts and texts of marks alone have no letters and go; a null language or id teaches nothing wrong:
    such rows are judged like any other. Documents between two equally likely languages are uncertain. Repeated rows are
    judged alike. Without a labelled row nothing is learnt and all documents go.
    """
    model = language_id.fit(docs.where(~F.coalesce(held_out(4, 2), F.lit(True))))
    lang, score = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "score")
    found = language_id.predict(docs, model, tuple(docs.columns), names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) > LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are depleted, and removes boilerplate lines from the rest.

    Null and empty texts fail. A null source is a host of its own. Exact copies count once among the documents that hold
    a line; a line in exactly ``MOST_DOCS_OF_A_LINE`` different documents stays. Repeated rows are judged alike.
    """
    return quality_rules.cleaned(docs, most_docs=MOST_DOCS_OF_A_LINE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id, null ids last.

    Near-duplicates have ``LEAST_SIMILARITY`` of their shingles of five words in common, found by Golay keys of
    fingerprints and by MinHash bands; links lead on, so a group's ends may differ more. Of rows that share that id too,
    the first read stays. Null and blank texts are one group.
    """
    return simhash.deduplicated(docs, similarity=LEAST_SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's limit in part.

    Null and blank texts are in no mix. A null source is a source of its own, ranked last. Documents that share their id
    are taken in the order of their sizes and texts' hashes.
    """
    return mixing.sampled(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset.

    Null and empty texts are one piece of one token. Repeated rows are packed once each; pieces of equal length are
    placed in the order of their ids and contents.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no tokenizer, fingerprint or segmentation model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
