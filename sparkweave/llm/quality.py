"""Quality rules: base counts of every document and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams (A-Z lowered) are counted: one over the trusted documents (label
quality 1; a fifth of them, by a hash of the id, is left out), one over all documents. A document's score is the sum of its n-grams' log ratios, divided
by its number of n-grams plus `prior`; documents under the threshold are rejected. The threshold lies a margin below the score that all
but a share `lost` of that fifth reach, so it is the same for every document and does not depend on their order.

Null texts count as empty. Empty texts have zero counts, score 0 and fail the base rule (fewer than 50 words). Equal
texts get equal rows. Labels, language, source and ids are not inputs of a score; other columns are not read.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import hash_segments, lower_ascii, release, slices, texts_of, windows, words_of
from .tables import Scratch

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SMALL = 1_000_000  # ids that are broadcast at most (about 32 MB); more are joined by a shuffle
CELLS, FEW = 1024, 10_000  # ranges of scores that are counted at a time, and scores of one that come to the driver


@dataclass(frozen=True)
class Params:
    buckets: int = 10_000  # hash buckets of the multinomials; what the driver holds
    prior: float = 50.0  # n-grams added to a document's length
    lost: float = 0.001  # share of the trusted documents left out below the lowest score that counts
    margin: float = 0.25  # of the way from the median to that score, by which the threshold lies below it


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray  # log(target / raw) by bucket
    threshold: float
    params: Params


def _grams(data, at, buckets):
    starts, ends, text = words_of(data, at)
    words = hash_segments(lower_ascii(data), starts, ends)
    pairs, owner, _ = windows(words, text, 2)
    return (np.concatenate([words, pairs]) % np.uint64(buckets)).astype(np.int64), np.concatenate([text, owner])


def base_counts(column) -> dict:
    """The base columns of each text of an Arrow string array, as arrays of 64-bit integers."""
    data, at = texts_of(column)
    n = len(at) - 1
    count = lambda owner: np.bincount(owner, minlength=n)
    starts, ends, text = words_of(data, at)
    out = {"n_words": count(text)}
    point = (data & 0xC0) != 0x80
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    out["word_chars"] = per(point & ~gap)
    out["n_symbols"] = per(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))
    # lines with a word: the segments between line ends and text ends that a word lies in
    edges = np.unique(np.concatenate([at, np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1]))
    line = np.unique(np.searchsorted(edges, starts, side="right") - 1)
    first, last = edges[line], edges[line + 1] if len(line) else edges[:0]
    hashes = hash_segments(data, first, last)
    owner = np.searchsorted(at, first, side="right") - 1
    order = np.lexsort((hashes, owner))
    again = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out["n_dup_lines"] = count(owner[order][1:][again])
    # words in three-word windows that the text has twice or more
    triples, owner, where = windows(hash_segments(data, starts, ends), text, 3)
    order = np.lexsort((triples, owner))
    same = (triples[order][1:] == triples[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    found = np.zeros(len(order), bool)
    found[1:] |= same
    found[:-1] |= same
    hit = np.zeros(len(starts) + 2, bool)
    for k in range(3):
        hit[where[order[found]] + k] = True
    out["n_repeat_words"] = count(text[hit[: len(starts)]])
    return {k: v.astype(np.int64) for k, v in out.items()}


def _scores(column, ratios, prior):
    data, at = texts_of(column)
    n = len(at) - 1
    grams, owner = _grams(data, at, len(ratios))
    return np.bincount(owner, weights=ratios[grams], minlength=n) / (np.bincount(owner, minlength=n) + prior)


def _placed(scores: DataFrame, places: list[int], few: int = FEW) -> list[float]:
    """Values of a column `score` at places (from 0) of its ascending order: the range that holds a place is cut into
    cells, and the cell into cells again, until one value or `few` rows are left."""
    out = []
    for place in places:
        part = scores
        low, high, n = part.agg(F.min("score"), F.max("score"), F.count("score")).first()
        while low < high and n > few:
            cell = F.least(F.floor((F.col("score") - low) / (high - low) * CELLS), F.lit(CELLS - 1))
            cells = part.groupBy(cell.alias("c")).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("score").alias("n"))
            for r in sorted(cells.collect(), key=lambda r: r.low):  # CELLS rows at most
                if place < r.n:
                    break
                place -= r.n
            low, high, n = r.low, r.high, r.n
            part = scores.where(F.col("score").between(low, high))
        out.append(low if low == high else sorted(r.score for r in part.collect())[place])
    return out


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Counts all documents and the trusted ones; labels has doc_id and quality. Without trusted rows nothing is rejected."""
    picked = labels.where("quality = 1").where("doc_id is not null").select("doc_id").distinct()
    apart = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0  # a fifth sets the threshold and is not counted
    small = F.broadcast if picked.count() <= SMALL else lambda df: df
    trusted = picked.where(~apart).withColumn("trusted", F.lit(True))
    buckets = params.buckets

    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            mark = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for first, last in slices(batch.column(0)):
                grams, owner = _grams(*texts_of(batch.column(0).slice(first, last - first)), buckets)
                raw += np.bincount(grams, minlength=buckets)
                target += np.bincount(grams[mark[first:last][owner]], minlength=buckets)
        release()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])

    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(small(trusted), "doc_id", "left")
    sums = marked.select("text", "trusted").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in sums.collect():  # one row for each bucket
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    ratios = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    if not target.sum():
        return Model(np.zeros(buckets), -np.inf, params)
    checked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(small(picked.where(apart)), "doc_id")
    scratch = Scratch(docs.sparkSession, "quality")
    scored = scratch.put(apply(checked, Model(ratios, -np.inf, params)).where("not base_failed").select("score"), "scores")
    n = scored.count()
    if not n:
        return Model(ratios, -np.inf, params)
    low, middle = _placed(scored, [int(n * params.lost), n // 2])
    scratch.drop("scores")
    return Model(ratios, low - params.margin * (middle - low), params)


def apply(docs: DataFrame, model: Model, keep: list[str] | None = None, kept_only: bool = False) -> DataFrame:
    """Base columns, score, base_failed and kept of every document. keep: columns that pass through (default doc_id).

    kept_only returns just the kept documents' `keep` columns, unchanged: the form for a filtering stage.
    """
    keep = ["doc_id"] if keep is None else keep
    ratios, threshold, prior = model.ratios, model.threshold, model.params.prior
    through = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = through if kept_only else f"{through}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, score double"

    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            for first, last in slices(texts):
                part = texts.slice(first, last - first)
                counts = base_counts(part)
                score = _scores(part, ratios, prior)
                failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
                kept = ~failed & (score >= threshold)
                passed = [batch.column(k).slice(first, last - first) for k in range(len(keep))]
                if kept_only:
                    yield pa.RecordBatch.from_arrays(passed, names=keep).filter(pa.array(kept))
                else:
                    made = [pa.array(counts[c]) for c in COUNTS] + [pa.array(failed), pa.array(kept), pa.array(score)]
                    yield pa.RecordBatch.from_arrays([*passed, *made], names=[*keep, *COUNTS, "base_failed", "kept", "score"])
            release()

    return docs.select(*[F.col(f"`{c}`") for c in keep], *[F.coalesce("text", F.lit("")).alias("__text")] * (at == len(keep))).mapInArrow(run, schema)
