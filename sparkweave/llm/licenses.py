"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are a text's blocks between blank lines. In each, every run of words as long as a template (and half as
long again, for words set between) in which at least `alike` of the template's bigrams stand is a window, found at any
word by the places of the bigrams; it may go over line ends. Of a template's overlapping windows the fullest is taken.
The classifier is a multinomial logistic regression over binary word unigrams and bigrams (A-Z lowered, outer
punctuation dropped) with an unknown class. It is trained here, on windows made from the families' templates by rule
(whole, without some words, inside other words) and, as unknown, on windows of at most Params.negatives lines of the
corpus that share less than half of any template's words. A third of these lines is left out of the training: with
them, whole or around scraps of templates, and with templates that lost words, a logistic curve is fitted that turns
the odds against the unknown class into a probability. Below `sure` a window is unknown. A predicted family is
confirmed if the containment of its best template's bigrams in the window reaches `alike`; unconfirmed ones are
unknown as well. Of overlapping windows the one alike most stays, and each family is named once in a paragraph.

Null and empty texts have no paragraphs and no findings; repeated rows are scanned alike; other columns are not read.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import slices

#: License families and wordings that announce them. Fixed values.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "Licensed under the MIT License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "Licensed under the BSD license."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GPL version 2."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential."],
}
FAMILIES = ["unknown", *TEMPLATES]
_BLANK = re.compile(r"\n[\x20\x09\x0B-\x0D]*(?=\n)")


@dataclass(frozen=True)
class Params:
    negatives: int = 3_000  # corpus paragraphs that the unknown class is trained on
    sure: float = 0.6
    alike: float = 0.5
    seed: int = 7


def _words(text: str) -> list[str]:
    return [w for w in (x.strip(".,;:()[]\"'") for x in re.findall(r"[^\x20\x09-\x0D]+", text.lower())) if w]


def _bigrams(words):
    return {f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)}


@dataclass
class Model:
    vocab: dict  # n-gram -> column
    weights: np.ndarray  # columns x families; the last row is the bias
    templates: list  # (family, bigrams, number of words)
    params: Params
    curve: tuple[float, float] = (1.0, 0.0)  # of the calibrated odds against the unknown class

    def features(self, words):
        """Columns of the n-grams of a paragraph, and the weight of each."""
        found = {self.vocab[g] for g in words if g in self.vocab} | {self.vocab[g] for g in _bigrams(words) if g in self.vocab}
        return sorted(found), 1 / np.sqrt(max(1, 2 * len(set(words)) - 1))

    def odds(self, words):
        """Log odds against the unknown class, the best family's number and its share of the known."""
        columns, weight = self.features(words)
        z = self.weights[columns].sum(axis=0) * weight + self.weights[-1]
        known = np.exp(z[1:] - z[1:].max())
        best = int(known.argmax())
        return float(z[1:].max() + np.log(known.sum()) - z[0]), best + 1, float(known[best] / known.sum())

    def classify(self, words):
        """family, calibrated probability, containment of the family's best template."""
        odds, best, share = self.odds(words)
        p = share / (1 + np.exp(-np.clip(self.curve[0] * odds + self.curve[1], -30, 30)))
        own, family = _bigrams(words), FAMILIES[best]
        alike = max(len(t & own) / len(t) for f, t, _ in self.templates if f == family)
        if p < self.params.sure or alike < self.params.alike:
            family = "unknown"
        return family, round(float(p), 6), round(alike, 6)

    def pairs(self):
        """(word, word) -> (bigram, numbers of the templates that hold it)."""
        out = {}
        for t, (_, grams, _) in enumerate(self.templates):
            for g in grams:
                out.setdefault(tuple(g.split(" ")), (g, []))[1].append(t)
        return out

    def windows(self, words, pairs):
        """(start, end) of the windows of a paragraph that hold enough bigrams of some template."""
        places = {}
        for i, hit in enumerate(map(pairs.get, zip(words, words[1:], strict=False))):
            if hit:
                for t in hit[1]:
                    places.setdefault(t, []).append((i, hit[0]))
        out = set()
        for t, hits in places.items():
            _, grams, length = self.templates[t]
            least = self.params.alike * len(grams)
            if len(hits) < least:
                continue
            found, met, last = [], {}, 0
            for first, (at, gram) in enumerate(hits):
                while last < len(hits) and hits[last][0] + 2 <= at + length + length // 2:
                    met[hits[last][1]] = met.get(hits[last][1], 0) + 1
                    last += 1
                if len(met) >= least:
                    found.append((-len(met), hits[last - 1][0] - at, at))
                met[gram] -= 1
                if not met[gram]:
                    del met[gram]
            taken = set()
            for _, span, at in sorted(found):
                end = min(len(words), max(at + span + 2, at + length))
                # a template that begins or ends with other words: the window has its whole length
                start = max(0, end - length) if end - at < length else at
                if taken.isdisjoint((at, at + span)):
                    taken.update(range(at, at + span + 1))
                    out.add((start, end))
        return sorted(out)

    def findings(self, words, pairs):
        """(family, probability, containment) of a paragraph, by place."""
        found = []
        for start, end in self.windows(words, pairs):
            family, p, alike = self.classify(words[start:end])
            if family != "unknown":
                found.append((-alike, -p, start, end, family))
        out, covered = {}, set()
        for alike, p, start, end, family in sorted(found):
            if covered.isdisjoint(range(start, end)):
                covered.update(range(start, end))
                if family not in out:
                    out[family] = (start, family, -p, -alike)
        return [x[1:] for x in sorted(out.values())]


def _curve(odds, known):
    """Slope and offset of the logistic curve from log odds to known or not, by Newton steps; ridge towards (1, 0)."""
    x = np.stack([np.asarray(odds, float), np.ones(len(odds))], axis=1)
    start = np.array([1.0, 0.0])
    w = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + np.eye(2), x.T @ (known - p) - (w - start))
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, params: Params = Params()) -> Model:
    """Model of the templates and a bounded sample of the corpus's paragraphs (docs: text)."""
    rng = np.random.default_rng(params.seed)
    known = {w for ts in TEMPLATES.values() for t in ts for w in _words(t)}
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) > 0)
    # lines whose hash lies below a bound that leaves some four times as many as are drawn: only these are shuffled
    count = lines.agg(F.approx_count_distinct(F.xxhash64("line"))).first()[0]
    share = min(1.0, 4 * params.negatives / max(1, count))
    drawn = lines.where(F.shiftrightunsigned(F.xxhash64("line"), 33) <= int(share * 2**31)).distinct().orderBy(F.xxhash64("line"), "line").limit(params.negatives).collect()
    pool = sorted({w for r in drawn for w in _words(r.line)}) or ["text"]
    x, y = [], []
    for label, family in enumerate(FAMILIES[1:], 1):
        for template in TEMPLATES[family]:
            words = _words(template)
            for k in range(30):
                kept = [w for w in words if k < 10 or rng.random() > 0.1]
                around = [pool[i] for i in rng.integers(0, len(pool), rng.integers(0, 12) if k >= 5 else 0)]
                cut = int(rng.integers(0, len(around) + 1))
                x.append(around[:cut] + kept + around[cut:])
                y.append(label)
    lengths = [len(_words(t)) for ts in TEMPLATES.values() for t in ts]

    def cut_out(words):
        n = lengths[int(rng.integers(0, len(lengths)))]
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        return words[at : at + n]

    foreign = [w for w in (cut_out(_words(r.line)) for r in drawn) if w and sum(v in known for v in w) < 0.5 * len(w)]
    held, foreign = foreign[::3], [w for k, w in enumerate(foreign) if k % 3]
    x += foreign
    y += [0] * len(foreign)
    for _ in range(500):  # single words of templates, out of their order
        some = sorted(known)
        x.append([some[i] for i in rng.integers(0, len(some), 4)] + [pool[i] for i in rng.integers(0, len(pool), 4)])
        y.append(0)
    grams = sorted(known | {g for ts in TEMPLATES.values() for t in ts for g in _bigrams(_words(t))})
    model = Model({g: k for k, g in enumerate(grams)}, np.zeros((len(grams) + 1, len(FAMILIES))), [(f, _bigrams(_words(t)), len(_words(t))) for f, ts in TEMPLATES.items() for t in ts], params)
    data = np.zeros((len(x), len(grams) + 1))
    for i, words in enumerate(x):
        columns, weight = model.features(words)
        data[i, columns] = weight
    data[:, -1] = 1
    target = np.eye(len(FAMILIES))[y]
    w, speed = np.zeros((data.shape[1], len(FAMILIES))), np.zeros((data.shape[1], len(FAMILIES)))
    for _ in range(300):  # gradient steps with momentum, ridge 1e-4
        z = data @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - 2.0 * (data.T @ (p - target) / len(x) + 1e-4 * w)
        w += speed
    model.weights = w
    # calibration on rows left out of the training: known are templates with lost words, unknown are foreign windows
    # alone and around a scrap of at most a third of a template
    tests = [(words, 0) for words in held]
    for k in range(40):
        for ts in TEMPLATES.values():
            for words in map(_words, ts):
                other = held[int(rng.integers(0, len(held)))] if held else ["text"] * len(words)
                n = max(1, len(words) // 3)
                at = int(rng.integers(0, len(words) - n + 1))
                tests.append((other[: len(words) - n] + words[at : at + n], 0))
                lost = [v for v in words if rng.random() > 0.1 * (k % 4)]
                tests.append((lost + other[: k % 3], 1))
    model.curve = _curve([model.odds(words)[0] for words, _ in tests], np.array([v for _, v in tests], float))
    return model


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, families (distinct, sorted), findings: (paragraph, family, probability, alike)."""
    schema = "doc_id long, n_paragraphs long, families array<string>, findings array<struct<paragraph:int,family:string,probability:double,alike:double>>"
    pairs = model.pairs()

    def run(batches):
        for batch in batches:
            for first, last in slices(batch.column(1)):
                rows, count = [], []
                for text in batch.column(1).slice(first, last - first).to_pylist():
                    found, n = [], 0
                    for block in _BLANK.split(text):
                        words = _words(block)
                        if words or block.split():
                            found += [{"paragraph": n, "family": f, "probability": p, "alike": alike} for f, p, alike in model.findings(words, pairs)]
                            n += 1
                    rows.append(found)
                    count.append(n)
                types = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("alike", pa.float64())]))
                names = [sorted({f["family"] for f in r}) for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(count, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(rows, types)], names=["doc_id", "n_paragraphs", "families", "findings"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
