"""Periodic runs of words by Lyndon arrays, in linear time over an ordered alphabet.

A run is a stretch of words with smallest period q and a length of at least max(least, 2 q) that no neighbouring word
extends with this period. Each run holds a Lyndon word of length q, for the order of words or for the reverse order,
that ends where the next smaller suffix starts (its edge). So two Lyndon arrays give all runs: an edge and the words by
which it can be extended to the right and to the left.

The array is built from left to right with a stack of previous smaller suffixes. Matched extensions are used again in
two ways: what a suffix shares with its previous smaller one tells what that one shares with the next (comparing goes on
only if both are equal), and inside the stretch that reaches furthest to the right, which repeats an earlier one, an
edge's extension is that of the earlier copy unless it meets the stretch's end. Extensions to the left reuse the stretch
that reaches furthest to the left in the same way. Words are only compared; there are no suffix structures or hashes.
A text's whole word sequence is one piece of work, in time and memory in proportion to it.

Words are runs of characters other than space and 0x09-0x0D; a null or empty text has none, and no runs. The collapsed
text is what is left without the words after a run's first period, joined by one space. Null and repeated ids are kept,
each row on its own; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import release, slices

RUNS = "array<struct<start:long,length:long,period:long>>"


def lyndon(w: list) -> tuple[list[int], list[int]]:
    """Start of the next smaller suffix of each suffix (the length if there is none), and the words that both share."""
    n = len(w)
    after, shares = [n] * n, [0] * n
    before, shared = [-1] * n, [0] * n  # the previous smaller suffix, and the words that both share
    b = end = shift = 0  # w[b:end] repeats what stands `shift` words earlier
    for r in range(1, n):
        c = w[r]
        left, last, m = r - 1, -1, 0
        while left >= 0:
            x = w[left]
            if x != c:
                m = 0
                if x < c:
                    break
            else:
                known = shared[last] if last >= 0 else 0
                if known < m:  # the suffix at `left` leaves the one at `last` before r does, and is smaller there
                    m = known
                    break
                if known == m:
                    done = False
                    if b < r < end:
                        i, j = (left - shift if left >= b else left), r - shift
                        k = -1
                        if 0 <= i < j:
                            k = shares[i] if after[i] == j else shared[j] if before[j] == i else -1
                        if 0 <= k < end - r:
                            m, done = k, True
                        elif k >= 0:
                            m = max(m, end - r)
                    if not done:
                        while r + m < n and w[left + m] == w[r + m]:
                            m += 1
                        if r + m > end:
                            b, end, shift = r, r + m, r - left
                    if r + m < n and w[left + m] < w[r + m]:
                        break
                # known > m: r leaves both in the same place, and is smaller there
                shares[left] = m
            after[left] = r
            last, left = left, before[left]
        before[r] = left
        if left >= 0:
            shared[r] = m
    return after, shares


def _of_order(w: list, least: int):
    after, shares = lyndon(w)
    back: dict[int, int] = {}  # words that an edge shares to the left
    s = a = shift = 0  # w[s:a] stands again `shift` words later
    for i in range(len(w) - 1, -1, -1):
        right = shares[i]
        if not right:  # a run's first Lyndon word is followed by at least one word of the run
            continue
        j = after[i]
        p = j - i
        if i >= p and after[i - p] == i and shares[i - p] >= p:  # not the first Lyndon word of its run
            continue
        m = 0
        if s < i and j <= a:
            k = back.get(i + shift, -1) if after[i + shift] == j + shift else -1
            if 0 <= k < i - s:
                m = -k - 1  # known
            elif k >= 0:
                m = i - s
        if m < 0:
            m = -m - 1
        else:
            while i > m and w[i - 1 - m] == w[j - 1 - m]:
                m += 1
            if i - m < s or s == a:
                s, a, shift = i - m, i, p
        back[i] = m
        if m + right >= p and m + right + p >= least:
            yield i - m, m + right + p, p


def runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    number: dict = {}
    w = [number.setdefault(x, len(number)) for x in words]
    if len(number) == len(w):  # no word comes twice
        return []
    return sorted({*_of_order(w, least), *_of_order([-x for x in w], least)})


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    kept, at = [], 0
    for start, end in sorted((s + p, s + n) for s, n, p in found):
        if end > at:
            kept += words[at : max(at, start)]
            at = end
    return b" ".join(kept + words[at:])


def _found(least, rewrite):
    def run(batches):
        for batch in batches:
            for first, last in slices(batch.column(1)):
                ids, texts = batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first).cast(pa.large_binary())
                count, spans, left = [], [], []
                for k in range(len(texts)):
                    words = (texts[k].as_py() or b"").split()  # bytes are parted at 0x20 and 0x09-0x0D
                    if rewrite:
                        words = rewrite(words, ids[k].as_py())
                    got = runs(words, least)
                    count.append(len(got))
                    spans += got
                    left.append(collapsed(words, got))
                columns = np.array(spans, np.int64).reshape(-1, 3)
                structs = pa.StructArray.from_arrays([pa.array(columns[:, c]) for c in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), structs)
                yield pa.record_batch([ids, lists, pa.array(left, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])
                release()

    return run


def find(df: DataFrame, least: int = 12, rewrite=None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, runs (array of start, length, period by start, then period), collapsed text of every row.

    rewrite(words, id), if given, changes a text's words (as UTF-8 bytes) before runs are looked for.
    """
    kind = df.schema[ident].dataType.simpleString()
    rows = df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_found(least, rewrite), f"id {kind}, runs {RUNS}, collapsed string").withColumnRenamed("id", ident)
