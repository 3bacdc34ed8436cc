"""Base counts against a plain count, the likelihood ratio against dictionaries."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkweave.llm import quality


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, hit = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)]


def test_counts():
    rng = random.Random(2)
    parts = ["a", "b ", "é", "\n", "#*", "\t", " ", "c d\n", "𝒳"]
    texts = [None, "", "\n\n", " a", "a b c a b c", "x\ny\nx\n\n\n x\nx"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    got = quality.base_counts(pa.array(texts))
    rows = zip(*[got[c].tolist() for c in quality.COUNTS], strict=True)
    assert [list(r) for r in rows] == [brute(t or "") for t in texts]


def test_threshold(spark):
    rng = random.Random(3)
    good, junk = [f"w{k}" for k in range(60)], [f"%{k}$$" for k in range(60)]
    rows = [(k, " ".join(rng.choice(good if k % 4 else junk) + str(rng.randint(0, 3)) for _ in range(120)), "s") for k in range(200)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "a b c " * 40, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 200, 2)] + [(None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.apply(docs, quality.fit(docs, labels)).collect()}
    assert not any(got[k].kept for k in range(0, 200, 4))
    assert all(got[k].kept for k in range(2, 200, 4)) and sum(got[k].kept for k in range(200)) >= 140
    assert got[900].n_words == 0 and got[900].base_failed and got[902].base_failed and not got[902].kept
    kept = quality.apply(docs, quality.fit(docs, labels), keep=docs.columns, kept_only=True)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.values())
    assert quality.apply(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0))).count() == 0
    assert got[0].score < got[1].score


def test_whole_reference(spark):
    """Every trusted document counts, and every one of the fifth left out is scored: 30,000 short ones, over the old limits."""
    n = 30_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.concat(F.lit("w"), (F.col("id") * 7 + k * k) % 997))).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    apart = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    buckets = 10_000
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for mark, into in ((F.lit(True), [raw]), (~apart, [target])):
        data, at = quality.texts_of(pa.array([r.text for r in rows.where(mark).collect()]))
        into[0] += np.bincount(quality._grams(data, at, buckets)[0], minlength=buckets)
    ratios = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    model = quality.fit(rows, labels)
    assert np.allclose(model.ratios, ratios, atol=1e-12)
    scores = np.sort(quality._scores(pa.array([r.text for r in rows.where(apart).collect()]), ratios, 50.0))
    assert len(scores) > 4_000
    low, middle = scores[int(len(scores) * 0.001)], scores[len(scores) // 2]
    assert abs(model.threshold - (low - 0.25 * (middle - low))) < 1e-12


def test_places(spark):
    values = np.random.default_rng(1).normal(size=3000).round(2)
    scores = spark.createDataFrame([(float(v),) for v in values], "score double")
    places = [0, 3, 1500, 2999]
    assert quality._placed(scores, places, few=5) == np.sort(values)[places].tolist()
