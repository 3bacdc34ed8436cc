"""Runs of words against all periods of all stretches, and the number of comparisons."""

import hashlib
import random
import re
import zlib

import pytest

from sparkweave.llm import periods, queries


def plain(w, least):
    n, out, hold = len(w), [], set()
    for p in range(1, n // 2 + 1):  # a stretch of a smaller period is known when its multiples come
        x = 0
        while x + p < n:
            y = x
            while y + p < n and w[y] == w[y + p]:
                y += 1
            if y - x >= p:
                inside = any(s <= x and y + p <= s + m and p % q == 0 for s, m, q in hold)
                if not inside:
                    hold.add((x, y + p - x, p))
                    if y + p - x >= least:
                        out.append((x, y + p - x, p))
            x = max(y, x + 1)
    return sorted(out)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return "".join(str(i.bit_count() % 2) for i in range(n))


@pytest.mark.parametrize("least", [1, 12])
def test_against_all_stretches(least):
    rng = random.Random(7)
    cases = ["", "a", "aa", "ab", "abab", "aabaabaa", "bananatree", "mississippi", fibonacci(90), thue_morse(90), "a" * 50, "ab" * 30, "aab" * 20 + "b" + "aab" * 9]
    for _ in range(1500):
        alphabet = "abcdefg"[: rng.randint(1, 5)]
        s = "".join(rng.choices(alphabet, k=rng.randint(0, 45)))
        if rng.random() < 0.5:
            root = "".join(rng.choices(alphabet, k=rng.randint(1, 9)))
            s = s[: rng.randint(0, 20)] + (root * rng.randint(2, 7))[: rng.randint(2, 40)] + s[20:]
        cases.append(s)
    for s in cases:
        assert periods.runs(list(s), least) == plain(s, least), s


class Word(int):
    looks = 0

    def __eq__(self, other):
        Word.looks += 1
        return int.__eq__(self, other)

    def __ne__(self, other):
        Word.looks += 1
        return int.__ne__(self, other)

    def __lt__(self, other):
        Word.looks += 1
        return int.__lt__(self, other)

    def __neg__(self):
        return Word(-int(self))

    __hash__ = int.__hash__


def test_comparisons_grow_in_proportion():
    rng = random.Random(2)

    def mixed(n):
        s = fibonacci(n // 4) + thue_morse(n // 4).translate({48: "a", 49: "b"})
        block = "".join(rng.choices("ab", k=n // 16))
        return (s + block * 4 + "a" * n)[:n]

    def nested(n):
        s = "a"
        while len(s) < n:
            s = s + s + chr(97 + len(s) % 3)
        return s[:n]

    families = {"one": lambda n: "a" * n, "two": lambda n: "ab" * (n // 2), "fibonacci": fibonacci, "back": lambda n: fibonacci(n)[::-1], "thue-morse": thue_morse, "random": lambda n: "".join(rng.choices("ab", k=n)), "mixed": mixed, "nested": nested, "power": lambda n: ("a" * 40 + "b") * (n // 41), "root": lambda n: "".join(rng.choices("ab", k=n // 5)) * 5}
    for name, make in families.items():
        for n in (2_000, 16_000):
            for sign in (1, -1):
                w = [Word(sign * ord(c)) for c in make(n)]
                Word.looks = 0
                list(periods._of_order(w, 12))
                assert Word.looks < 9 * n, (name, n, sign, Word.looks / n)


def as_query(ident, text):
    """The query's rows by the definition of its contract."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(ident).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain(words, 12)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (ident, len(found), *best, milli, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_its_definition(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = rng.choices(["a", "B", "b", "é x", "\x1cq", "the"], k=rng.choice([0, 1, 5, 30, 80]))
        root = rng.choices(["a", "b", "c"], k=rng.randint(1, 9))
        words[10:10] = (root * 8)[: rng.choice([0, 11, 12, 13, 24])]
        rows.append((i, rng.choice([" ", "\n\t", "\x0b\x0c\r "]).join(words), "x", 3))
    rows += [(7, "a a a a a a a a a a a a", "y", 1), (7, None, "y", 1), (-5, "", "y", 1), (9, " \n", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periods(spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r)[:8] for r in got.collect()), key=str) == sorted((as_query(i, t) for i, t, *_ in rows), key=str)
    nothing = periods.find(df.where("doc_id is null"))
    assert nothing.count() == 0
    one = periods.find(spark.createDataFrame([(None, "x y " * 8)], "doc_id long, text string")).first()
    assert one.doc_id is None and [tuple(r) for r in one.runs] == [(0, 16, 2)] and one.collapsed == "x y"
    assert periods.find(spark.createDataFrame([(1, "to be or not " * 100_000)], "doc_id long, text string")).first().collapsed == "to be or not"
