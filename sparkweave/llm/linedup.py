"""Line dedup as an exact set-similarity join, by DataFrame functions only.

A line (split at line feeds) is the set of its distinct words: runs of characters other than space, tab, vertical tab,
form feed and carriage return, as they are written. A line matches an earlier one - of a smaller doc_id, or of a
smaller number in the same document - if the Jaccard similarity of their sets is 0.8 or more. Every line that matches
an earlier line is removed, whether or not that one is itself removed. Lines without words stay.

Equal sets are one class: all its lines but the first go, and the first goes if a similar class starts earlier. Words
are ordered by rarity: the counts of all words, added up in SLOTS cells by hash, give each word one of 128 frequency
levels (a constant of SLOTS bytes, of a fixed size for any input); rarer levels come first, ties by hash. A set of n
words shows the first n - ceil(0.8 n) + 1 of this order. Similar sets show a common word (prefix filter), neither has
over 5/4 of the other's words (length filter), and the places of the common word leave room for enough common words
before and after it (position filter). Each shown word travels with 64 parity bits of its whole set (128 of longer sets): bits in which
two sets differ are at most the words in which they differ, which drops almost all other pairs inside the join. Sets
that show the same two words in a row meet at the first of them only. What passes is verified on the whole sets.

Pairs are made in three rounds. In the first a set meets, for each of the FEW rarest words that it shows, the earliest
set that has it among them and the BEFORE ones before itself, and is held against the likeliest of these. In the second,
sets that are not beaten do so by the other words that they show, against the TRIES likeliest: near copies with rare words
of their own meet only there. Beaten sets need no further round, though they still beat others; so most members of a large
group of near copies cost no more than any other set. In the third round all that are left meet all earlier sets. Sets of
up to three words match equal ones only.

Words are compared by their levels and 55 bits of their hashes, equal sets by 64-bit hashes of these. Null texts stay
null, empty ones empty; rows without an id are left alone and beat none; what is removed for one of several rows with an
id is removed, by its line number, from all of them; other columns pass through unchanged.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import let
from .tables import Scratch

SLOTS = 1 << 17
PLACE = (1 << 31) - 1
ROW = 1024  # cells that come to the driver in one row
LONG = 30  # words over which a set has 128 parity bits
FEW = 2  # shown words of the first round
TRIES = 12  # sets that a set is held against in the second round at most
BEFORE = 6  # sets before itself that a set meets there
SMALL = 1_000_000  # lines whose numbers are broadcast at most (about 32 MB); more are joined by a shuffle


def _small(df: DataFrame) -> DataFrame:
    """A table for a join: broadcast if it is proven to be small. It is read twice."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _plain(text: Column) -> Column:
    """Text with spaces for the characters between words other than line feeds."""
    return F.when(text.rlike("[\t\x0b\x0c\r]"), F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def _levels(docs: DataFrame) -> bytes:
    """Frequency level (0 to 127, eight to a doubling) of the words of each cell, a byte each."""
    words = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word")).where("word <> ''")
    counts = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(SLOTS)).cast("int").alias("slot")).agg(F.count("*").alias("k"))
    cells = counts.select("slot", F.least(F.lit(127), F.round(4 * F.log2(F.col("k") + 1)).cast("int")).alias("level"))
    rows = cells.groupBy(F.floor(F.col("slot") / ROW)).agg(F.collect_list(F.struct("slot", "level")).alias("cells"))
    out = bytearray(SLOTS)
    for r in rows.select("cells.slot", "cells.level").toLocalIterator():  # SLOTS / ROW rows at most
        for slot, level in zip(r.slot, r.level, strict=True):
            out[slot] = level
    return bytes(out)


def _need(n: Column) -> Column:
    """ceil(0.8 n)"""
    return F.floor((4 * n + 4) / 5).cast("int")


def _ranked(line: Column, levels: Column) -> Column:
    """The distinct words of a plain line, sorted by level and hash: the level above the upper bits of the hash."""

    def rank(word):
        w = F.xxhash64(word)
        level = F.ascii(F.substring(levels, F.pmod(w, F.lit(SLOTS)).cast("int") + 1, F.lit(1)).cast("string"))
        return F.shiftleft(level.cast("long"), 55).bitwiseOR(F.shiftrightunsigned(w, 9))

    return F.sort_array(F.array_distinct(F.transform(F.array_remove(F.split(line, " "), ""), rank)))


def _parity(words: Column, half: int | None = None) -> Column:
    """64 bits, of which each word turns one; with half (0 or 1) only the words of that half do."""
    one = F.lit(1).cast("long")

    def turn(bits, w):
        new = bits.bitwiseXOR(F.call_function("shiftleft", one, (w % 64).cast("int")))
        return new if half is None else F.when(w.bitwiseAND(F.lit(64)) == 64 * half, new).otherwise(bits)

    return F.aggregate(words, F.lit(0).cast("long"), turn)


def _end(name: str):
    """Columns of one end of a pair."""
    return lambda c: F.col(f"{name}.{c}")


def _pair(x, y) -> list[Column]:
    return [x("doc").alias("doc"), x("line").alias("line"), y("doc").alias("doc2"), y("line").alias("line2")]


def _earlier(x, y) -> Column:
    return (x("doc") < y("doc")) | ((x("doc") == y("doc")) & (x("line") < y("line")))


def _words(z) -> Column:
    return F.shiftrightunsigned(z("meta"), 31).bitwiseAND(F.lit(PLACE))


def _apart(x, y) -> Column:
    """Parity bits in which two sets differ."""
    bits, more = x("bits").bitwiseXOR(y("bits")), x("more").bitwiseXOR(y("more"))
    return F.when((_words(x) > LONG) & (_words(y) > LONG), F.bit_count(bits) + F.bit_count(more)).otherwise(F.bit_count(bits.bitwiseXOR(more)))


def _close(x, y) -> Column:
    """Whether two sets that show a word may be similar, and meet here first. y.meta of a beaten set counts as a set of
    too many words."""
    n, m = _words(x), F.shiftrightunsigned(y("meta"), 31)
    i, j = x("meta").bitwiseAND(F.lit(PLACE)), y("meta").bitwiseAND(F.lit(PLACE))
    room = F.least(i, j) + F.least(n - i, m - j)
    near = (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * _apart(x, y) <= n + m) & (9 * room >= 4 * (n + m))
    return near & ((i == 0) | (j == 0) | (x("prev") != y("prev")))


def _shown(sets: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """word, prev, doc, line, meta (beaten, words and place of the word, packed), parity bits: a row for each shown word
    from the place start to the one before end."""
    packed = F.when(F.col("beaten"), F.lit(1 << 62)).otherwise(F.lit(0).cast("long")) + F.shiftleft(F.col("n").cast("long"), 31)
    head = F.slice("head", 1, end) if end else F.col("head")
    pairs = F.arrays_zip(head.alias("word"), F.concat(F.array(F.lit(0).cast("long")), F.slice(head, 1, F.size(head) - 1)).alias("prev"))
    rows = sets.where("head is not null").select("doc", "line", packed.alias("meta"), "bits", "more", F.posexplode(pairs).alias("place", "one"))
    return rows.where(F.col("place") >= start).select("one.word", "one.prev", "doc", "line", (F.col("meta") + F.col("place")).alias("meta"), "bits", "more")


def _likeliest(shown: DataFrame, most: int) -> DataFrame:
    """doc, line, doc2, line2: for sets that are not beaten, the earlier sets (most at most) in which the fewest parity bits
    differ, among the earliest set of each shown word and the BEFORE ones before the set itself."""
    own = F.struct("doc", "line", "meta", "bits", "more", "prev")
    at = W.partitionBy("word").orderBy("doc", "line")
    met = shown.select(own.alias("y"), F.array(F.first(own).over(at), *[F.lag(own, k).over(at) for k in range(1, BEFORE + 1)]).alias("xs"))
    met = met.where(F.col("y.meta") < 1 << 62).select("y", F.explode("xs").alias("x")).where("x is not null")
    x, y = _end("x"), _end("y")
    met = met.where(_earlier(x, y) & _close(x, y)).select(*_pair(x, y), _apart(x, y).alias("apart"))
    best = met.groupBy("doc2", "line2").agg(F.slice(F.array_sort(F.collect_set(F.struct("apart", "doc", "line"))), 1, most).alias("best"))
    return best.select("doc2", "line2", F.explode("best").alias("x")).select("x.doc", "x.line", "doc2", "line2")


def _similar(docs: DataFrame, levels: Column, pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """doc, line of the later sets of those pairs (doc, line; doc2, line2, the later) that are similar. docs: plain texts."""
    pairs = scratch.put(pairs.distinct(), f"pairs-{name}")
    lines = scratch.put(pairs.select("doc", "line").union(pairs.select("doc2", "line2")).distinct(), f"lines-{name}")
    some = docs.join(_small(lines.select(F.col("doc").alias("doc_id")).distinct()), "doc_id", "left_semi")
    bodies = some.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "body"))
    picked = bodies.join(_small(lines), ["doc", "line"]).select("doc", "line", _ranked(F.col("body"), levels).alias("words"))
    picked = scratch.put(picked, f"words-{name}")
    both = pairs.join(picked, ["doc", "line"]).join(picked.toDF("doc2", "line2", "words2"), ["doc2", "line2"])
    alike = both.where(9 * F.size(F.array_intersect("words", "words2")) >= 4 * (F.size("words") + F.size("words2")))
    found = scratch.put(alike.select(F.col("doc2").alias("doc"), F.col("line2").alias("line")).distinct(), f"beaten-{name}")
    scratch.drop(f"pairs-{name}", f"lines-{name}", f"words-{name}")
    return found


def _marked(sets: DataFrame, beaten: DataFrame) -> DataFrame:
    found = _small(beaten).withColumn("beaten", F.lit(True))
    return sets.join(found, ["doc", "line"], "left").withColumn("beaten", F.coalesce("beaten", F.lit(False)))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, lines: the numbers from 0 of each document's removed lines, if any. docs: doc_id, text."""
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", _plain(F.col("text")).alias("text"))
    levels = F.lit(_levels(docs))
    lines = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "body"))
    n = F.size("words")
    head = F.when(n > 3, F.slice("words", 1, n - _need(n) + 1)).alias("head")
    sets = lines.where("ltrim(body) <> ''").select("doc", "line", _ranked(F.col("body"), levels).alias("words"))
    bits = F.when(n > LONG, _parity(F.col("words"), 0)).when(n > 3, _parity(F.col("words"))).alias("bits")
    more = F.when(n > LONG, _parity(F.col("words"), 1)).otherwise(F.lit(0).cast("long")).alias("more")
    every = scratch.put(sets.select("doc", "line", F.xxhash64("words").alias("h"), n.alias("n"), head, bits, more), "every")
    # the lines of equal sets but the first
    many = every.groupBy("h").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("k")).where("k > 1").select("h", "first")
    many = scratch.put(many, "many")
    copies = scratch.put(every.select("doc", "line", "h").join(_small(many), "h").where("struct(doc, line) <> first").select("doc", "line", "h"), "copies")
    first = every.join(_small(copies), ["doc", "line", "h"], "left_anti")

    beaten = _similar(docs, levels, _likeliest(_shown(first.withColumn("beaten", F.lit(False)), 0, FEW), 1), scratch, "one")
    marked = _marked(first, beaten)
    beaten = beaten.union(_similar(docs, levels, _likeliest(_shown(marked, FEW), TRIES), scratch, "two"))
    shown = _shown(_marked(first, beaten))
    x, y = _end("x"), _end("y")
    pairs = shown.alias("x").join(shown.alias("y").hint("merge"), (x("word") == y("word")) & _earlier(x, y) & _close(x, y))
    beaten = beaten.union(_similar(docs, levels, pairs.select(*_pair(x, y)), scratch, "three"))
    # with the first of a class all of it goes
    classes = scratch.put(first.select("doc", "line", "h").join(_small(beaten), ["doc", "line"]).select("h").distinct(), "classes")
    gone = every.select("doc", "line", "h").join(_small(classes), "h", "left_semi").select("doc", "line").union(copies.select("doc", "line"))
    gone = scratch.put(gone.groupBy(F.col("doc").alias("doc_id")).agg(F.array_sort(F.collect_set("line")).alias("lines")), "gone")
    scratch.drop("every", "many", "copies", "classes", "beaten-one", "beaten-two", "beaten-three")
    return gone


def clean(docs: DataFrame) -> DataFrame:
    """docs without the removed lines; other columns and their order as before. docs: doc_id, text and others."""
    gone = removed(docs)
    size = gone.agg(F.sum(F.size("lines"))).first()[0] or 0
    gone = F.broadcast(gone) if size <= SMALL else gone
    return _without(docs.join(gone.withColumnRenamed("lines", "__gone"), "doc_id", "left"), docs.columns)


def _without(joined: DataFrame, columns: list[str]) -> DataFrame:
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")), lambda i: F.get(lines, i))
    kept = F.array_join(let(F.split("text", "\n"), left), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in columns])
