"""Line dedup against a brute-force comparison of all lines."""

import random
import re

from sparkweave.llm import linedup


def brute(rows):
    lines = [(i, k, frozenset(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, t, _ in rows if t is not None for k, x in enumerate(t.split("\n"))]
    lines.sort(key=lambda x: x[:2])
    gone = set()
    for j, (i, k, s) in enumerate(lines):
        if s and any(o and 10 * len(s & o) >= 8 * len(s | o) for _, _, o in lines[:j]):
            gone.add((i, k))
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t, _ in rows}


def test_against_all_pairs(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(40)] + ["é", "𝒳", "the", "of"]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 14))] for _ in range(25)]
    rows = [(900, None, "x"), (901, "", "x"), (902, " \n\t\n", "x"), (903, "the\nthe\nof the\nthe of", "y"), (904, "a" * 50000 + "\n" + "a" * 50000, "z")]
    for i in range(120):
        out = []
        for _ in range(rng.randint(1, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(vocab)
            out.append(" ".join(line) + rng.choice(["", " ", "\t"]))
        rows.append((i, "\n".join(out), "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lines string")
    got = {r.doc_id: r.text for r in linedup.clean(df).collect()}
    assert got == brute(rows)


def test_repeated_and_missing_ids(spark):
    line = "a b c d e f g h i j"
    rows = [(1, line), (1, line), (2, "x y z w v\n" + line), (2, "other words in here\n" + line + " k"), (None, line), (3, line + " l\nnew")]
    got = sorted((r.doc_id or 0, r.text) for r in linedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, line), (1, line), (2, "x y z w v"), (2, "other words in here"), (0, line), (3, "new")])


def test_groups_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"v{k}" for k in range(64)]  # some of its copies have more distinct words than LONG, some fewer
    rows = [(k, " ".join(w if rng.random() > 0.06 else f"u{rng.randint(0, 9)}" for w in base) + "\ncommon line of words"[: rng.choice((0, 22))]) for k in range(250)]
    got = {r.doc_id: r.text for r in linedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute([(*r, "") for r in rows])


def test_near_copies_with_rare_words_of_their_own(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"v{k}" for k in range(60)]
    rows = [(0, " ".join(base))]
    for k in range(1, 301):
        words = list(base)
        for at in rng.sample(range(60), 3):
            words[at] = f"only{k}x{at}"
        rows.append((k, " ".join(words)))
    pairs, similar = [], linedup._similar

    def counted(docs, levels, found, scratch, name):
        pairs.append(found.distinct().count())
        return similar(docs, levels, found, scratch, name)

    monkeypatch.setattr(linedup, "_similar", counted)
    got = {r.doc_id: r.text for r in linedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute([(*r, "") for r in rows])
    assert sum(pairs) <= 20 * len(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, h long")
    assert linedup.clean(df).collect() == []
