"""Classes of near duplicates against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa

from sparkweave.llm import jaccard


def brute(rows):
    sets, parent = {}, {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, o in sets.items():
            if j < i and s and 100 * len(s & o) >= 80 * len(s | o):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 400)}"
    passage = " ".join(word() for _ in range(60))
    base = [[word() for _ in range(rng.choice((3, 8, 40, 90)))] for _ in range(12)]
    rows = [(1000, None, "x"), (1001, "", "x"), (1002, "Same Words", "x"), (1003, "same words", "x"), (1004, " \n", "x"), (1005, "z" * 50000, "y")]
    for i in range(330):
        text = list(base[0 if i < 90 else rng.randrange(len(base))])
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = word()
        if i % 5 == 0:
            text.insert(rng.randrange(len(text)), passage)
        rows.append((i, " ".join(text), "x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string, n string")).collect()}
    assert got == brute(rows)


def test_repeated_and_missing_ids(spark):
    a, b, c = ("a b c d e f g h i j k l m n o p q r s t", "one two three four five six seven", "something else that stands here alone")
    rows = [(5, a), (5, b), (3, b), (7, a), (7, a), (9, c), (None, a), (None, c), (-2, c), (11, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(False, 5, 16, 3), (False, 5, 3, 3), (False, 3, 3, 3), (False, 7, 16, 3), (False, 7, 16, 3), (False, 9, 2, -2), (False, -2, 2, -2), (True, 0, 16, None), (True, 0, 2, None), (False, 11, 0, 11)])


def test_empty(spark):
    assert jaccard.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_meet_at_few_of_their_combinations():
    rng = np.random.default_rng(4)
    base = np.sort(rng.integers(-(1 << 62), 1 << 62, 400))
    sets = [np.sort(np.where(rng.random(400) < 0.06 * (k % 3), rng.integers(-(1 << 62), 1 << 62, 400), base)) for k in range(12)]
    size = 400 - 320 + 1 + 21
    shown = [[{"pos": p, "token": int(t), "often": True} for p, t in enumerate(s[:size])] for s in sets]
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("token", pa.int64()), ("often", pa.bool_())]))
    ids, bits = pa.array(range(12), pa.int64()), pa.array([[0] * (jaccard.BITS // 64)] * 12, pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array([400] * 12, pa.int64()), pa.array(shown, kind), bits], names=["doc", "root", "n", "shown", "bits"])
    rows = pa.Table.from_batches(jaccard._signatures([batch])).to_pandas()
    met = rows.merge(rows, on="sig").query("doc_x < doc_y and kind_x > 0")
    few = met
    for c in ("prev", *jaccard.OVERS):
        few = few[(few[f"{c}_x"] != few[f"{c}_y"]) | (few[f"{c}_x"] == 0)]
    every = set(zip(met.doc_x, met.doc_y))
    assert len(every) > 20 and set(zip(few.doc_x, few.doc_y)) == every
    assert 5 * len(few) < len(met)
