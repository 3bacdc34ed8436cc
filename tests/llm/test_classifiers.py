"""Toxicity on held-out rows and exact neighbours; licenses on planted lines."""

import random
import zlib
from collections import Counter

import numpy as np

from sparkweave.llm import licenses, toxicity


def corpus(rng, n=400):
    word = lambda: "".join(rng.choice(("th", "er", "in", "on", "es", "ou", "ha")) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        if k % 4 == 0:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(("zorblat", "quixbad", "vyrmix")) + rng.choice(("", "ed", "ly"))
        rows.append((k, " ".join(words), 0.5))
        labels.append((k, int(k % 4 == 0)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(random.Random(4))
    rows += [(9000, None, 0.1), (9001, "", 0.1), (9002, "x" * 50000, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.apply(docs, model).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((got[k] >= 0.7) == (k % 4 == 0) for k in held) >= 0.95 * len(held)
    assert got[9000] == got[9001] < 0.3
    none = toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 1e-6 for r in toxicity.apply(docs, none).collect())


def test_neighbours_are_exact(spark):
    rows, labels = corpus(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.Params(k=5))
    dense = np.zeros((len(model.index.labels), len(model.terms)))
    for t, (numbers, weights) in enumerate(model.index.post):
        dense[numbers, t] = weights
    matcher, seen = model.matcher(), 0
    for _, text, _ in rows:
        bag = Counter(t for _, t in matcher.iter(toxicity._plain(text)))
        if bag:
            terms, value = model.vector(bag)
            value = value / np.sqrt((value**2).sum())
            want = np.sort(np.round(dense[:, terms] @ value, 9))[::-1][:5]
            _, cosines = model.index.nearest(terms, value, 5)
            assert np.allclose(cosines, want[want > 0], atol=1e-8)
            seen += 1
    assert seen > 50


def test_licenses(spark):
    rng = random.Random(6)
    rows, _ = corpus(rng, 120)
    lines = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "proprietary": "All rights reserved.", "CC-BY-NC": "Licensed under CC BY-NC 4.0."}
    rows = [(k, t + "\n" + list(lines.values())[k % 4] if k % 3 == 0 else t, s) for k, t, s in rows]
    rows += [(500, None, 0.0), (501, "", 0.0), (502, "all the rights are reserved here, version", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, findings double")
    got = {r.doc_id: r for r in licenses.scan(docs, licenses.fit(docs)).collect()}
    for k in range(120):
        assert got[k].families == ([list(lines)[k % 4]] if k % 3 == 0 else []), k
    assert got[500].families == [] and got[500].n_paragraphs == 0 and got[502].families == []


def test_wrapped_and_embedded_licenses(spark):
    rng = random.Random(8)
    rows, _ = corpus(rng, 120)
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal in the\nSoftware without restriction"
    gpl = "This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation"
    lgpl = gpl.replace("GNU General", "GNU Lesser General")
    long = " ".join(t for _, t, _ in rows[:40])
    texts = [
        (mit, ["MIT"], 1), (gpl, ["GPL"], 1), (lgpl, ["LGPL"], 1), (f"{long}\n{mit}\n{long}", ["MIT"], 1), (f"{long} Licensed under CC BY-NC 4.0. {long}", ["CC-BY-NC"], 1),
        (f"a b\n \t\n{long} {gpl} {long} All rights reserved. {long}\n\n\nend", ["GPL", "proprietary"], 3), (f"{long} licensed under the {long} free of charge to any person {long}", [], 1),
        ("under the terms of the treaty the rights of the author are related to this work", [], 1),
    ]
    docs = spark.createDataFrame([(1000 + k, t, s) for k, t, s in rows] + [(k, t, 0.0) for k, (t, _, _) in enumerate(texts)], "doc_id long, text string, x double")
    got = {r.doc_id: r for r in licenses.scan(docs, licenses.fit(docs)).collect()}
    for k, (_, families, blocks) in enumerate(texts):
        assert (got[k].families, got[k].n_paragraphs) == (families, blocks), (k, got[k].findings)
    assert [f.paragraph for f in got[5].findings] == [1, 1]
    assert not any(got[1000 + k].families for k, _, _ in rows)
