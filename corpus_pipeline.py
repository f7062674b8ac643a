"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Each row is judged by itself, whatever rows share its doc_id or have none; a null text is an empty
one; columns of any other name pass through; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from scoutframe.llm import jaccard, pack, passages, quality, toxicity
from scoutframe.llm._shared import stored, table


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the quality rules, with thresholds from these documents; repeated rows share their fate."""
    return quality.filter_documents(docs)


def toxicity_filter(spark, docs, sf_dir):
    """Documents that score below the toxicity threshold; without labels of both kinds none is toxic, or all are as labelled."""
    return toxicity.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One row of each group of near duplicates: the one with the smallest doc_id (null is largest); rows without words all stay."""
    return jaccard.filter_documents(docs)


def substring_dedup(spark, docs, sf_dir):
    """Texts without the passages that stand in a document with a smaller doc_id; rows of which nothing is left go."""
    return passages.filter_documents(docs)


def packing(spark, docs, sf_dir):
    """Pieces of all documents in sequences of at most 4096 ids: one row a piece, with a checksum of its ids; an empty text has one."""
    import public_tokenizers

    return pack.packed_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]
#: The toxicity and packing stages can't be put in SQL; tests hold the near-duplicate, substring and packing stages against
#: brute force, the quality counts and held-out toxicity too, and the run against its stages.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
