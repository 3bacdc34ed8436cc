"""Encoding against the tokenizers library, decoding as round trip."""

import random

import numpy as np
import pytest

from sparkweave.llm import bpe
from sparkweave.llm.tables import vocabulary

tokenizers = pytest.importorskip("tokenizers")
ALPHABETS = ("abc", "aaaab", "etaoin shrdlu", "ab \x1c\n\x85!?", "éèüßñ ΣİǅéÀ가́𝒳", "thinanre", "'s'll'd3 !!##")


def texts():
    rng = random.Random(1)
    out = ["", " ", "a" * 3000, "<|endoftext|>a<|startoftext|><|ENDOFTEXT|>", "x<|endoftext|>" * 50, "don't we'll it's", "9" * 700]
    return out + ["".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(0, 30))) for _ in range(1500)]


def test_like_the_library(spark):
    path = vocabulary()
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(k, t, 1) for k, t in enumerate([None, *texts()])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.encode(df, path, keep=["doc_id"], decode=True).collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[k].ids == want, repr((t or "")[:60])
        assert got[k].decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), path, keep=["doc_id"]).count() == 0


def test_automaton_against_merging():
    """Any merge list: the automaton's labels are those of merging pair by pair."""
    rng = random.Random(2)
    for _ in range(30):
        labels, merges = list("abc"), []
        for _ in range(12):
            u, v = rng.choice(labels), rng.choice(labels)
            if u + v not in labels:
                merges.append((u, v))
                labels.append(u + v)
        model = bpe.MergeAutomaton({x: i for i, x in enumerate(labels)}, merges)
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 15))) for _ in range(60)]
        for word, ids in zip(words, model.encode_words(words, most=10), strict=True):
            parts = list(word)
            for u, v in merges:
                k = 0
                while k < len(parts) - 1:
                    if parts[k] == u and parts[k + 1] == v:
                        parts[k : k + 2] = [u + v]
                    k += 1
            assert [labels[i] for i in np.frombuffer(ids, "<i4")] == parts, (merges, word)
