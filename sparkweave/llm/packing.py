"""Best-fit packing of tokenised documents into sequences of bounded length, improved by a swap-based local search.

Documents are cut into pieces of at most `capacity` tokens (only longer ones are cut). Full pieces are sequences of
their own. The others are dealt by a hash of their row number into groups of bounded size; each group is packed by
best-fit decreasing, and a local search then exchanges one for one, two for one, or moves pieces between underfull
bins, taking a step only if it increases the sum of squared fills, until emptier bins run empty and none are left to
improve. What is left in a group's underfull bins goes on to further rounds with fewer groups, so that bins are few in
proportion to all rows and no task ever sees more than a group.

Null texts count as empty; every document has at least one piece (its end mark). Rows that repeat an id, or have none or
a negative one, are packed one by one like any others: groups and full pieces go by row numbers of the written pieces.
"""

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .bytehash import release, slices
from .tables import Scratch

CAPACITY = 4096
END = 1  # id after each document
GROUP = 4_000  # pieces of a group on average
_CRC = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; with ids also the piece's ids."""
    import zlib

    schema = _CRC + (", ids array<int>" if ids else "")

    def run(batches):
        model = bpe.encoder(path)
        for batch in batches:
            for first, last in slices(batch.column(1), 4 << 20):
                keys = batch.column(0).slice(first, last - first).to_pylist()
                coded, where = model.encode(batch.column(1).slice(first, last - first))
                raw = memoryview(np.insert(coded, where[1:], END).astype("<i4").tobytes())
                where = where + np.arange(len(where))
                rows, parts = [], []
                for key, begin, stop in zip(keys, where[:-1].tolist(), where[1:].tolist(), strict=True):
                    for k, at in enumerate(range(begin, stop, capacity)):
                        part = raw[4 * at : 4 * min(stop, at + capacity)]
                        rows.append((key, k, at - begin, len(part) // 4, zlib.crc32(part)))
                        if ids:
                            parts.append(part)
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    where = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])])
                    arrays.append(pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            release()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def _best_fit(lengths, capacity):
    """Best-fit decreasing: bins as lists of piece numbers, and their fills."""
    bins, fill, room = [], [], []  # room: sorted (free, bin)
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(k)
            fill[b] += n
            insort(room, (free - n, b))
        else:
            bins.append([k])
            fill.append(n)
            insort(room, (capacity - n, len(bins) - 1))
    return bins, fill


def _gives(members, size):
    """What an emptier bin can give in one step: amounts in order, and the pieces of each. Single pieces, and pairs."""
    single = {}
    for k in members:
        single.setdefault(size[k], (k,))
    both = dict(single)
    order = sorted(members, key=lambda k: size[k])
    for i, j in enumerate(order):
        for k in order[i + 1 :]:
            both.setdefault(size[j] + size[k], (j, k))
    return (np.array(sorted(single)), single), (np.array(sorted(both)), both)


def _largest(amounts, takes, free):
    """The largest gain by giving one of the amounts for what is taken back, where at most `free` fits; -1 for none."""
    at = np.searchsorted(amounts, takes + free, side="right") - 1
    gain = np.where(at >= 0, amounts[np.maximum(at, 0)] - takes, -1)
    best = int(gain.argmax()) if len(gain) else -1
    return (int(gain[best]), best, int(amounts[at[best]])) if best >= 0 and gain[best] > 0 else (0, -1, 0)


def pack(lengths, capacity: int = CAPACITY):
    """Bin of each piece and its place there. Bins that an exchange could still fill are searched; empty ones vanish.

    A fuller bin gains tokens from an emptier one by a piece moved to it, by one exchanged for a shorter one, or by two
    exchanged for one; every such step increases the sum of squared fills. For each bin, emptiest first, the largest
    gain among all fuller bins is taken until there is none. The search ends when no pair of bins has a step; a pair is
    looked at again only if one of its bins has changed since.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    bins, filled = _best_fit(lengths, capacity)
    size = lengths.tolist()
    fill = np.array(filled, dtype=np.int64)
    where = np.zeros(len(lengths), np.int64)  # bin of each piece
    for b, members in enumerate(bins):
        where[members] = b
    changed, seen, clock = np.ones(len(bins), np.int64), np.zeros(len(bins), np.int64), 1  # times of change and of the last look
    moved = True
    while moved:
        moved = False
        under = np.flatnonzero((fill > 0) & (fill < capacity))
        live = np.flatnonzero(np.isin(where, under))  # pieces of bins that can take part; a full bin stays full
        for low in under[np.argsort(fill[under], kind="stable")].tolist():
            while fill[low]:
                since = 0 if changed[low] > seen[low] else seen[low]
                fit = (changed[under] > since) & (fill[under] >= fill[low]) & (fill[under] < capacity) & (under != low)
                highs = under[fit]
                if not len(highs):
                    break
                held = where[live]
                pieces = live[(changed[held] > since) & (fill[held] >= fill[low]) & (fill[held] < capacity) & (held != low)]
                (one, by_one), (any_, by_any) = _gives(bins[low], size)
                move, m, given = _largest(one, np.zeros(len(highs), np.int64), capacity - fill[highs])
                swap, x, sent = _largest(any_, lengths[pieces], capacity - fill[where[pieces]])
                gain = max(move, swap)
                if not gain:
                    break
                if move >= swap:
                    high, out, into = int(highs[m]), (), by_one[given]
                else:
                    high, out, into = int(where[pieces[x]]), (int(pieces[x]),), by_any[sent]
                bins[high] = [k for k in bins[high] if k not in out] + list(into)
                bins[low] = [k for k in bins[low] if k not in into] + list(out)
                where[list(into)] = high
                where[list(out)] = low
                fill[high] += gain
                fill[low] -= gain
                clock += 1
                changed[high] = changed[low] = clock
                moved = True
            seen[low] = clock
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, members in enumerate(m for m in bins if m):
        at = 0
        for k in members:
            number[k], offset[k] = b, at
            at += size[k]
    return number, offset


def place(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """parts with sequence_id and offset. parts: doc_id, piece, length and others, as a written table: it is read more
    than once, and its row numbers must not change.

    A sequence's id is (round and group) * 2**32 + its number there; those of full pieces are negative. The rounds are a
    bound of the search, not of the rows: bins filled to 97 % or more are final before the last one.
    """
    columns = parts.columns
    spark = parts.sparkSession
    scratch = Scratch(spark, "packing")
    full = parts.where(F.col("length") == capacity)
    loose = parts.where(F.col("length") < capacity)
    # a full piece's sequence is its own: its row number, below zero, where the rounds have no ids
    done = [full.select(*columns, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    schema = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in columns) + ", sequence_id long, offset long, __open boolean"

    def deal(level, groups):
        def run(key, frame):
            frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
            number, offset = pack(frame["length"].to_numpy(), capacity)
            fill = np.bincount(number, weights=frame["length"])
            last = fill[number] < capacity * 0.97 if level < 3 and groups > 1 else np.zeros(len(frame), bool)
            base = ((level * (1 << 24)) + int(key[0])) << 32
            return frame[columns].assign(sequence_id=base + number, offset=offset, __open=last)

        return run

    rows = loose
    for level in (1, 2, 3):
        count = rows.count()
        groups = max(1, -(-count // group))
        keyed = rows.withColumn("__group", F.pmod(F.xxhash64(F.lit(level), F.monotonically_increasing_id()), F.lit(groups)))
        packed = scratch.put(keyed.groupBy("__group").applyInPandas(deal(level, groups), schema), f"round{level}")
        done.append(packed.where("not __open").drop("__open"))
        rows = packed.where("__open").select(*columns)
        if groups == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out

