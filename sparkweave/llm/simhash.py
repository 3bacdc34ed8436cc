"""SimHash near-duplicate classes by deletion-variant signatures.

Texts are lower-cased (A-Z) and cut into words, runs of characters other than space and 0x09-0x0D. Each run of three
words, joined by one space, counts as often as it stands there (fewer words: the whole sequence). A bit of the 64-bit
fingerprint is one if more than half of the XXH64 hashes (seed 42) have it. Fingerprints link at three differing bits
or fewer; texts without words have fingerprint zero and link like any other.

Index: a fingerprint is cut into two segments of 32 bits. Of three differing bits one segment holds at most one, so two
linked fingerprints agree in a segment, or in all of it but one bit. Each distinct fingerprint therefore shows, for each
segment and each of its bits, the segment with this bit deleted: 64 keys. Linked fingerprints share a key. Keys of one
fingerprint go at once.

Links are found in two turns. First, along each key, a fingerprint is held against the smallest one and against the one
before it; a dense group becomes one component at a cost in proportion to its members. Then only what is left is looked
at: keys on which several components meet. There a fingerprint shows the rest in four further pieces of eight bits, of
which one agrees if the rest differs in three bits or fewer; fingerprints that share key and piece and are in different
components are joined and verified. No link between components is lost, none within one is needed.

Null texts count as empty. A null id is kept: its text takes part, but it is never a component_id, unless a component
has no other id; then component_id is null. Several rows of one id are rows of their own. Other columns are not read; an
empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytehash import release
from .components import components
from .tables import Scratch

SEED = 42
WORDS = 3
MOST = 3  # bits in which linked fingerprints differ at most
HALF = 32
PIECE = 8
MASK = (1 << HALF) - 1
STEP = 1 << 16  # hashes whose bits are counted at a time


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    words = (text or b"").lower().split()  # bytes: only A-Z are lowered, and only 0x20 and 0x09-0x0D part words
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - WORDS + 1)
    last = ends[-n:].tolist()
    digest, above = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        spans = zip(first[at : min(n, at + STEP)].tolist(), last[at : at + STEP], strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype="<u8")
        above += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * above > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        found = np.fromiter((fingerprint(texts[i].as_py()) for i in range(len(texts))), np.int64, len(texts))
        yield pa.record_batch([batch.column(0), pa.array(found)], ["id", "mark"])
        del texts
        release()


def _half(mark: Column, upper: int) -> Column:
    return F.shiftrightunsigned(mark, HALF) if upper else mark.bitwiseAND(F.lit(MASK))


def _keys(mark: Column) -> Column:
    """64 keys: the segment with one bit deleted (set to zero), below the number of the segment and the bit."""
    out = []
    for upper in (0, 1):
        for bit in range(HALF):
            rest = _half(mark, upper).bitwiseAND(F.lit(MASK ^ (1 << bit)))
            out.append(rest + F.lit((upper * HALF + bit) << HALF))
    return F.array(*out)


def _pieces(key: Column, mark: Column) -> Column:
    """Four numbers: a piece of the segment that the key does not show, with the piece's place."""
    upper = F.shiftrightunsigned(key, HALF + 5) == 1  # numbers from 32: the key shows the upper segment
    rest = F.when(upper, _half(mark, 0)).otherwise(_half(mark, 1))
    return F.array(*[F.shiftrightunsigned(rest, p * PIECE).bitwiseAND(F.lit(255)) + 256 * p for p in range(HALF // PIECE)])


def _apart(a, b) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def linked(marks: DataFrame, scratch: Scratch) -> DataFrame:
    """mark, root of each fingerprint that links with another; root is the smallest of its component. marks: distinct."""
    shown = marks.select("mark", F.explode(_keys(F.col("mark"))).alias("key"))
    on = W.partitionBy("key")
    by = on.orderBy("mark")
    met = shown.select("key", "mark", F.first("mark").over(by).alias("least"), F.lag("mark").over(by).alias("before"), F.lead("mark").over(by).alias("after"))
    met = scratch.put(met.where("before is not null or after is not null").drop("after"), "met")  # keys of several
    other = F.explode(F.array_distinct(F.array("least", "before"))).alias("b")
    near = met.where("before is not null").select(F.col("mark").alias("a"), other).where(_apart("a", "b") <= MOST).distinct()
    near = scratch.put(near, "near")
    root = scratch.put(components(near, scratch, "first").withColumnRenamed("node", "mark"), "root")
    rooted = met.select("key", "mark").join(root, "mark", "left").select("key", "mark", F.coalesce("root", "mark").alias("root"))
    rooted = scratch.put(rooted, "rooted")
    # a key with one component has nothing left to find
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left = rooted.join(several, "key", "left_semi").select("key", "mark", "root", F.explode(_pieces(F.col("key"), F.col("mark"))).alias("piece"))
    left = scratch.put(left, "left")
    x, y = left.alias("x"), left.alias("y")
    on = [F.col("x.key") == F.col("y.key"), F.col("x.piece") == F.col("y.piece"), F.col("x.root") < F.col("y.root"), _apart("x.mark", "y.mark") <= MOST]
    more = x.join(y, on[0] & on[1] & on[2] & on[3]).select(F.col("x.root").alias("a"), F.col("y.root").alias("b")).distinct()
    more = scratch.put(more, "more")
    stars = root.where("mark <> root").select(F.col("mark").alias("a"), F.col("root").alias("b"))
    found = scratch.put(components(stars.union(more), scratch, "all").withColumnRenamed("node", "mark"), "all")
    scratch.drop("met", "near", "root", "rooted", "left", "more")
    return found


def classes(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, fingerprint (16 hexadecimal digits), component_id (smallest id of its component) of every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(_fingerprints, f"id {kind}, mark long")
    rows = scratch.put(rows, "rows")
    marks = scratch.put(rows.groupBy("mark").agg(F.min("id").alias("id")), "marks")
    root = linked(marks.select("mark"), scratch)
    rooted = marks.join(root, "mark", "left").select("mark", "id", F.coalesce("root", "mark").alias("root"))
    rooted = scratch.put(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = scratch.put(rooted.select("mark", "root").join(least, "root").select("mark", "component_id"), "named")
    # a fingerprint stands once on the right; copies on the left are split by adaptive execution
    out = rows.join(named, "mark")
    return out.select(F.col("id").alias(ident), F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id")
