"""Corpus pipeline: quality rules, line dedup, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Documents that the quality rules reject go; lines that match earlier ones go; of each class of near
duplicates the document with the smallest id stays; personal data is replaced by its kind; the rest is packed into
sequences. Null texts fail the quality rules; an empty table passes through as empty.
"""

from pyspark.sql import functions as F

from sparkweave.llm import jaccard, linedup, packing, pii, quality
from sparkweave.llm.tables import Scratch, table, vocabulary

#: The stages are not SQL as a whole (hashed likelihoods, tokens); they are tested against brute-force versions.
ORACLE_SQL = None


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and the likelihood threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.apply(docs, model, keep=docs.columns, kept_only=True)


def _counted(docs):
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def line_dedup(spark, docs, sf_dir):
    """Documents without lines that match an earlier line."""
    return _counted(linedup.clean(docs))


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of near duplicates."""
    return jaccard.one_each(docs)


def personal_data(spark, docs, sf_dir):
    """Documents with personal data replaced."""
    return _counted(pii.redact(docs))


def best_fit_packing(spark, docs, sf_dir):
    """Pieces of the documents and their places in sequences."""
    return packing.place(Scratch(spark, "pieces").put(packing.pieces(docs, vocabulary()), "pieces"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]


def run(spark, sf_dir):
    """The last stage's rows over documents; each stage is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(docs, f"stage{k}")
    return docs
