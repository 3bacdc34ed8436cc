"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Learning uses labelled rows whose crc32(doc_id as text) mod 3 is not 1, and of them a sample of at most
Params.examples of each label, by a hash of the id. Terms are character n-grams of the lower-cased words (a word starts
and ends with a space), counted over the whole sample; those that speak for the label are kept, at most Params.terms,
by a chi-square of their document counts. An example is its TF-IDF vector over these terms. The inverted index keeps,
for each term and each block of 64 examples, the largest weight. A query bounds each block's best cosine by these,
visits blocks from the highest bound down, and stops when no block can enter the k nearest: the k nearest are exact,
ties by example number. Neighbours vote by cosine; the vote, the cosine of the nearest and the weight of the terms
found go into a logistic calibration that is fitted to the sample itself, each example without itself.

Empty and null texts and texts without terms have no neighbours and get the calibrated score of no evidence. Equal
texts get equal scores. Without labelled rows of both labels every score is 0. Labels, lang, source and ids are not
inputs of a score; other columns are not read.
"""

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import slices

_GAP = re.compile(r"[\W\d_]+")
BLOCK = 64
HEAD = 11  # longest word beginning, with its space


@dataclass(frozen=True)
class Params:
    examples: int = 4_000  # labelled rows of each label
    terms: int = 2_000
    lengths: tuple[int, ...] = (4, 5, 6)  # of the n-grams inside words; beginnings and whole words are terms as well
    least: int = 6  # documents of label 1 with a term
    purity: float = 0.9  # share of label 1 among the documents with a term, labels taken as equally frequent
    k: int = 16


def _plain(text: str) -> str:
    return f" {_GAP.sub(' ', text.lower())} "


def _grams(text: str, lengths) -> set:
    out = set()
    for word in set(_plain(text).split()):
        word = f" {word} "
        out.add(word)
        out.update(word[:k] for k in range(4, min(len(word), HEAD) + 1))
        for n in lengths:
            out.update(word[k : k + n] for k in range(1, len(word) - n + 1))
    return out


@dataclass
class Index:
    """Examples by number: block-max inverted index. post[t]: (examples, weights), sorted; cut[t]: where each block's
    postings begin; top: largest weight, terms x blocks."""

    post: list
    cut: np.ndarray
    top: np.ndarray
    labels: np.ndarray
    ids: list

    def _scored(self, terms, weights, blocks):
        """Cosines of all examples of some blocks; each block's rows are read from its own part of the postings."""
        score = np.zeros(self.top.shape[1] * BLOCK)
        every = len(blocks) > 16
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            rows, value = self.post[t]
            if every:
                score[rows] += w * value
            else:
                cut = self.cut[t]
                for b in blocks:
                    if cut[b + 1] > cut[b]:
                        part = slice(cut[b], cut[b + 1])
                        score[rows[part]] += w * value[part]
        return score

    def nearest(self, terms, weights, k: int, skip: int = -1):
        """Numbers and cosines of the k nearest examples with a cosine over 0; ties by number.

        The blocks of the highest bounds are scored first; of the others only those whose bound reaches the k-th best
        cosine found there can hold a nearer example, and they are scored as well.
        """
        bounds = weights @ self.top[terms]
        order = np.argsort(-bounds, kind="stable")
        first = order[:4].tolist()
        score = self._scored(terms, weights, first)
        found = score[np.concatenate([np.arange(b * BLOCK, (b + 1) * BLOCK) for b in first])]
        least = np.partition(found, -k - 1)[-k - 1] if len(found) > k else 0.0  # one more than k: `skip` may be among them
        rest = [b for b in order[4:].tolist() if bounds[b] > 0 and bounds[b] >= least - 1e-9]
        if rest:
            score = self._scored(terms, weights, first + rest)
        score = np.round(score, 12)
        if skip >= 0:
            score[skip] = 0
        hits = np.flatnonzero(score > 0)
        hits = hits[np.lexsort((hits, -score[hits]))][:k]
        return hits.tolist(), score[hits].tolist()


@dataclass
class Model:
    terms: dict
    idf: np.ndarray
    index: Index | None
    weights: np.ndarray  # of the calibration
    params: Params

    def vector(self, counts: Counter):
        terms = np.array(sorted(counts), dtype=np.int64)
        value = (1 + np.log(np.array([counts[t] for t in terms.tolist()], dtype=float))) * self.idf[terms]
        return terms, value

    def evidence(self, counts: Counter, skip: int = -1):
        """Inputs of the calibration, and the neighbours."""
        if not counts:
            return np.array([1.0, 0.0, 0.0, 0.0]), []
        terms, value = self.vector(counts)
        total = float(np.sqrt((value**2).sum()))
        near, cosines = self.index.nearest(terms, value / total, self.params.k, skip)
        if not near:
            return np.array([1.0, 0.0, 0.0, 0.0]), []
        vote = float(np.dot(cosines, self.index.labels[near]) / sum(cosines))
        return np.array([1.0, vote * cosines[0], vote, np.log1p(total)]), near

    def score(self, x) -> float:
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for text, t in self.terms.items():
            found.add_word(text, t)
        if self.terms:
            found.make_automaton()
        return found


def _logistic(x, y, ridge=1.0, steps=50):
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * w)
        w += change
        if np.abs(change).max() < 1e-9:
            break
    return w


def _distinct(rows, most: int) -> list:
    """The first `most` terms that are not, with about the same documents, a part or an extension of an earlier one."""
    out, by_count = [], {}
    for r in rows:
        near = [t for c in range(int(r.one * 0.9), int(r.one * 1.1) + 1) for t in by_count.get(c, ())]
        if not any(r.term in t or t in r.term for t in near):
            out.append(r)
            by_count.setdefault(r.one, []).append(r.term)
            if len(out) == most:
                break
    return out


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Model of docs (doc_id, text) and labels (doc_id, toxic)."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = None
    for label in (0, 1):
        part = usable.where(F.col("toxic") == label).orderBy(*order).limit(params.examples)
        sample = part if sample is None else sample.union(part)
    # at most 2 * params.examples ids
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])

    def count(batches):
        with_one, with_zero = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (with_one if label else with_zero).update(_grams(text, params.lengths))
        # terms of label 1 only can be kept; label 0 counts of others are not needed, but may meet them elsewhere
        terms = list(with_one.keys() | with_zero.keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([with_one[t] for t in terms], pa.int64()), pa.array([with_zero[t] for t in terms], pa.int64())], names=["term", "one", "zero"])

    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    none = Model({}, np.zeros(0), None, np.array([-40.0, 0, 0, 0]), params)
    if not n1 or not n0:
        return none
    counts = rows.select("text", "toxic").mapInArrow(count, "term string, one long, zero long").groupBy("term").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    share = (F.col("one") / n1) / (F.col("one") / n1 + F.col("zero") / n0)
    a, b, c, d = F.col("one"), F.col("zero"), n1 - F.col("one"), n0 - F.col("zero")
    chi = (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) + 1.0)
    kept = counts.where((F.col("one") >= params.least) & (share >= params.purity)).withColumn("chi", chi.cast("double"))
    chosen = _distinct(kept.orderBy(F.desc("chi"), "term").limit(4 * params.terms).collect(), params.terms)
    if not chosen:
        return none
    terms = {r.term: k for k, r in enumerate(chosen)}
    idf = np.array([np.log((1 + n0 + n1) / (1 + r.one + r.zero)) + 1 for r in chosen])
    model = Model(terms, idf, None, none.weights, params)

    def found(batches):
        matcher = model.matcher()
        for batch in batches:
            hits = [Counter(t for _, t in matcher.iter(_plain(x))) for x in batch.column(1).to_pylist()]
            arrays = [batch.column(0), batch.column(2), pa.array([list(h) for h in hits], pa.list_(pa.int64())), pa.array([list(h.values()) for h in hits], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "toxic", "term", "k"])

    examples = rows.select("doc_id", "text", "toxic").mapInArrow(found, "doc_id long, toxic int, term array<long>, k array<long>").orderBy("doc_id").collect()
    bags = [Counter(dict(zip(r.term, r.k, strict=True))) for r in examples]
    used = [i for i, bag in enumerate(bags) if bag]
    blocks = max(1, -(-len(used) // BLOCK))
    post, top = [([], []) for _ in terms], np.zeros((len(terms), blocks))
    for number, i in enumerate(used):
        at, value = model.vector(bags[i])
        value = value / np.sqrt((value**2).sum())
        for t, w in zip(at.tolist(), value.tolist(), strict=True):
            post[t][0].append(number)
            post[t][1].append(w)
            top[t, number // BLOCK] = max(top[t, number // BLOCK], w)
    packed = [(np.array(r, np.int64), np.array(w)) for r, w in post]
    cut = np.array([np.searchsorted(r, np.arange(blocks + 1) * BLOCK) for r, _ in packed])
    model.index = Index(packed, cut, top, np.array([examples[i].toxic for i in used], float), [examples[i].doc_id for i in used])
    number = {i: k for k, i in enumerate(used)}
    x = np.array([model.evidence(bag, number.get(i, -1))[0] for i, bag in enumerate(bags)])
    y = np.array([r.toxic for r in examples], float)
    model.weights = _logistic(x, y)
    return model


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, neighbours (ids of the nearest examples) of every row of docs (doc_id, text)."""

    def run(batches):
        matcher = model.matcher()
        nothing = model.score(np.array([1.0, 0.0, 0.0, 0.0]))
        for batch in batches:
            for first, last in slices(batch.column(1)):
                scores, near = [], []
                for text in batch.column(1).slice(first, last - first).to_pylist():
                    bag = Counter(t for _, t in matcher.iter(_plain(text))) if model.terms else ()
                    x, found = model.evidence(bag) if bag else (None, [])
                    scores.append(nothing if x is None else model.score(x))
                    near.append([model.index.ids[n] for n in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(scores), pa.array(near, pa.list_(pa.int64()))], names=["doc_id", "score", "neighbours"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double, neighbours array<long>")
