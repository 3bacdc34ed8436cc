"""Exact n-gram Jaccard join by token-combination prefixes, and its connected components.

A document is the set of its distinct five-word shingles (A-Z lowered; the whole word sequence if it has fewer words;
empty without words or text). Two documents link if 100 * |intersection| >= 80 * |union|.

Equal sets are one representative. Shingles are ordered by their 64-bit hashes, and each set shows only the head of
this order. Linked sets differ in at most e = n - ceil(0.8 n) of a set's n members, so a head in which e + 1 members
would have to be missing must meet a partner's head. For components not every link is needed: first, in a few turns,
each set is held against one other of its best partners among those that stand first or last for a shingle of its head
and are in another component; large groups of near copies become one component at a cost in proportion to them. Then
all is done that is left: shingles shown in two components at least are indexed, those of at most RARE components one
by one. Frequent ones are split into classes by hash and indexed as combinations of two of one class: a class of c
members stands for c - 1 missing ones, so a head is extended by one member for each class that it touches. A set whose
head has e + 1 rare members needs no combinations of its own and only offers them to those that do. The number of
classes follows the set's size; sizes that differ by a quarter at most share a size class or lie in neighbouring ones,
and combinations are made for both.

Sets of one entry of the index are joined if they are in different components, if their sizes and BITS parity bits
(which differ in no more places than the sets do) allow a link and if the places of a rare member leave room for it; the
sets of an entry's largest component meet only the others. Two sets that share many combinations are joined by few of
them: not by one whose class has a common member next below the larger of the two, nor if one of the OVER classes before
its own is the same in both. Each pair found is verified on the whole texts: a text
travels to each of its partners once, and a partner of many is copied to parts of PART texts.

Null and empty texts have no shingles and are components of their own; rows without an id have no component and link
with nothing; rows that repeat an id are one document: all of them are in one component. Other columns are not read.
Hashes have 64 bits: two of m different shingles share one with probability m * m / 2**65.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import mix, release, shingles_of, slices
from .components import components
from .tables import Scratch

RARE = 16  # components that may show a shingle which is indexed alone
TURNS = 3  # turns that verify one partner of each set before all that is left is verified
KEYS = 6  # shingles of a head that a turn looks at
PART = 100  # texts that a copy of their partner is made for
SMALL = 1_000_000  # rows of a few numbers that are broadcast at most (32 MB); more are joined by a shuffle
BITS = 512
OVER = 4  # classes before its own of which a combination knows the members
OVERS = tuple(f"over{k}" for k in range(OVER))
_SIZES = np.unique(np.ceil(1.25 ** np.arange(0, 120)).astype(np.float64))


def _missing(n):
    """Members of a set of n that a linked set may lack at most."""
    return n - (4 * n + 4) // 5


def _size_class(n):
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.25) + 1e-12).astype(np.int64)


def _classes(size_class):
    """Classes of frequent shingles for a size class: about five shown members each."""
    low = np.floor(1.25 ** np.asarray(size_class, dtype=np.float64))
    return np.maximum(1, np.ceil((0.2 * low + 1) / 4)).astype(np.int64)


def _signed(x):
    """Unsigned hashes as signed integers of the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _parity(grams, at):
    """BITS bits of each set, as rows of 64-bit integers; each member turns one of them."""
    out = np.zeros((len(at) - 1, BITS // 64), np.uint64)
    some = np.flatnonzero(np.diff(at))
    word, bit = (grams >> np.uint64(8)) % np.uint64(BITS // 64), np.uint64(1) << ((grams >> np.uint64(16)) & np.uint64(63))
    for k in range(BITS // 64 if len(some) else 0):
        out[some, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), at[some])
    return out.view(np.int64)


def _heads(batches):
    """doc, n, s1, s2 (two hashes of the whole set), its parity bits and the head of the set."""
    for batch in batches:
        for first, last in slices(batch.column(1)):
            grams, at = shingles_of(batch.column(1).slice(first, last - first))
            n = np.diff(at)
            sums = []
            for salt in (0x51, 0xA7):
                mixed = np.concatenate([[0], np.cumsum(mix(grams + np.uint64(salt)), dtype=np.uint64)]).astype(np.uint64)
                sums.append((mixed[at[1:]] - mixed[at[:-1]]).view(np.int64))
            size = np.minimum(n, _missing(n) + 1 + _classes(_size_class(n) + 1))
            where = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(where[-1]) - np.repeat(where[:-1], size) + np.repeat(at[:-1], size)
            head = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(_signed(grams[take])))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (BITS // 64), pa.int32()), pa.array(_parity(grams, at).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), bits, head], names=["doc", "n", "s1", "s2", "bits", "head"])
        release()


def _classes_before(own, group, token):
    """For members sorted by set, class and hash: hashes of the members of each of the OVER classes numbered just below their
    own, as columns; 0 for a class of less than two members in the set."""
    first = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(group) != 0)])[: len(own)])
    size = np.diff(np.append(first, len(own)))
    if not len(first):
        return np.zeros((0, OVER), np.int64)
    whole = np.where(size > 1, np.add.reduceat(mix(token.view(np.uint64)), first).view(np.int64), 0)
    key = own[first] * (1 << 32) + group[first]
    out = np.zeros((len(first), OVER), np.int64)
    for k in range(OVER):
        at = np.minimum(np.searchsorted(key, key - k - 1), len(key) - 1)
        out[:, k] = np.where((key[at] == key - k - 1) & (group[first] > k), whole[at], 0)
    return np.repeat(out, size, axis=0)


def _signatures(batches):
    """From the indexed shingles of each set's head (place, token, often): its entries in the index, with parity bits.

    kind 0: a rare shingle, with its place and the rare one at the place before; 1: a combination of a set that needs
    combinations; 2: one that is only offered. A combination has the other member of its class next below the larger of
    the two (prev), and hashes of the OVER classes before its own: sets in which one of these is equal meet at a smaller
    combination too.
    """
    names = ["sig", "kind", "doc", "root", "n", "pos", "prev", *OVERS]
    words = BITS // 64
    for batch in batches:
        doc, root, n = (batch.column(k).to_numpy() for k in range(3))
        shown, bits = batch.column(3), batch.column(4).flatten().to_numpy().reshape(-1, words)
        own = np.repeat(np.arange(len(doc)), np.diff(shown.offsets.to_numpy()))
        fields = shown.flatten()
        pos, token, often = fields.field("pos").to_numpy(), fields.field("token").to_numpy(), fields.field("often").to_numpy(zero_copy_only=False)
        order = np.lexsort((pos, own))
        own, pos, token, often = own[order], pos[order].astype(np.int64), token[order], often[order]
        need, base = _missing(n) + 1, _size_class(n)
        size = np.minimum(n, need + _classes(base + 1))
        enough = size - np.bincount(own[often], minlength=len(doc)) >= need

        def ends(f):
            """Ends of heads that the places f (sorted by set and place) make one longer each."""
            o = own[f]
            rank = np.arange(len(f)) - np.searchsorted(o, o)
            inside = pos[f] < need[o] + rank
            return np.minimum(size, need + np.bincount(o[inside], minlength=len(doc)))

        out, owners = {c: [] for c in names}, []

        def add(sig, kind, o, place, before, over):
            for c, v in zip(names, (sig, kind, doc[o], root[o], n[o], place, before, *over.T), strict=True):
                out[c].append(v)
            owners.append(o)

        freq = np.flatnonzero(often)
        whole, longest = ends(freq), np.zeros(len(doc), np.int64)
        for b in (base, base + 1):
            group = (mix(token[freq].view(np.uint64) + b[own[freq]].astype(np.uint64)) % _classes(b)[own[freq]].astype(np.uint64)).astype(np.int64)
            by_class = np.lexsort((pos[freq], group, own[freq]))
            first = np.ones(len(freq), bool)
            first[1:] = (np.diff(own[freq][by_class]) != 0) | (np.diff(group[by_class]) != 0)
            end = np.where(enough, whole, ends(np.sort(freq[by_class[first]])))
            longest = np.maximum(longest, end)
            inside = np.flatnonzero(pos[freq] < end[own[freq]])
            o, g, t = own[freq][inside], group[inside], token[freq][inside]
            order = np.lexsort((t, g, o))
            o, g, t = o[order], g[order], t[order]
            over = _classes_before(o, g, t)
            for step in range(1, len(o)):
                same = (g[step:] == g[:-step]) & (o[step:] == o[:-step])
                if not same.any():
                    break
                left, right, mine = t[:-step][same].view(np.uint64), t[step:][same].view(np.uint64), o[step:][same]
                at = np.flatnonzero(same)
                if step > 1:
                    before = t[at + step - 1]
                else:
                    back = np.maximum(at - 1, 0)
                    before = np.where((at > 0) & (o[back] == mine) & (g[back] == g[at]), t[back], 0)
                add(mix(mix(left + b[mine].astype(np.uint64)) ^ right).view(np.int64), np.where(enough[mine], 2, 1), mine, np.zeros(len(mine), np.int64), before, over[at])
        alone = np.flatnonzero(~often & (pos < longest[own]))
        before = np.zeros(len(alone), np.int64)  # 0: none
        near = (np.diff(own[alone]) == 0) & (np.diff(pos[alone]) == 1)
        before[1:][near] = token[alone][:-1][near]
        add(token[alone], np.zeros(len(alone), np.int64), own[alone], pos[alone], before, np.zeros((len(alone), OVER), np.int64))
        mine = bits[np.concatenate(owners)]
        arrays = [pa.array(np.concatenate(out[c])) for c in names] + [pa.array(np.ascontiguousarray(mine[:, k])) for k in range(words)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(f"b{k}" for k in range(words))])


def _compare(batches):
    """Rows sorted by b, part and later; the text of b comes first, then those of its partners -> the linked pairs."""
    key, sets = None, []
    for batch in batches:
        for first, last in slices(batch.column(4), 1 << 20):
            part = batch.slice(first, last - first)
            grams, at = shingles_of(part.column(4))
            b, salt, later, doc = (part.column(k).to_pylist() for k in range(4))
            found = []
            for k in range(len(b)):
                own = grams[at[k] : at[k + 1]]
                if (b[k], salt[k]) != key:
                    key, sets = (b[k], salt[k]), []
                if not later[k]:
                    sets.append(own.copy())
                    continue
                for other in sets:
                    place = np.minimum(np.searchsorted(other, own), len(other) - 1)
                    common = int((other[place] == own).sum())
                    if 100 * common >= 80 * (len(own) + len(other) - common):
                        found.append((doc[k], b[k]))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def _few(df: DataFrame) -> DataFrame:
    """A table for a join: broadcast if it is proven to be small. It is read twice."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _near(n, m):
    """Sizes that linked sets can have."""
    return (5 * n >= 4 * m) & (5 * m >= 4 * n)


def _apart(x, y):
    """Parity bits in which two sets differ: at most the members in which they do."""
    return sum((F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(BITS // 64)), F.lit(0))


class _Join:
    """The state of one join: the written sets, and each representative's component so far."""

    def __init__(self, docs: DataFrame):
        self.scratch = Scratch(docs.sparkSession, "jaccard")
        self.plain = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
        self.base = self.scratch.put(self.plain.mapInArrow(_heads, "doc long, n long, s1 long, s2 long, bits array<long>, head array<long>"), "base")
        real = self.base.where("n > 0 and doc is not null").select("doc", "n", "s1", "s2")
        many = self.scratch.put(real.groupBy("s1", "s2").agg(F.min("doc").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k"), "many")
        copies = real.join(_few(many), ["s1", "s2"]).where("doc <> rep").select("doc", "s1", "s2", "rep").distinct()
        self.copies = _few(self.scratch.put(copies, "copies"))
        self.heads = self.base.where("n > 0 and doc is not null").join(self.copies, ["doc", "s1", "s2"], "left_anti").select("doc", "n", "bits", "head")
        self.named = self.scratch.put(self.heads.select("doc", F.col("doc").alias("root")).distinct(), "named")
        # rows that repeat an id with other words: what their copies stand for is one document
        twice = real.groupBy("doc").agg(F.countDistinct("s1", "s2").alias("k")).where("k > 1").select("doc")
        self.merge(self.copies.join(twice, "doc", "left_semi").select(F.col("doc").alias("a"), F.col("rep").alias("b")), "same")

    def merge(self, links: DataFrame, name: str) -> bool:
        """Joins the components of linked sets; False if there are none. links: a, b."""
        roots = self.named
        ends = [_few(roots.select(F.col("doc").alias(c), F.col("root").alias(f"root_{c}"))) for c in ("a", "b")]
        between = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        between = self.scratch.put(between.where("a <> b").distinct(), f"links-{name}")
        if between.isEmpty():
            return False
        joined = components(between, self.scratch, f"roots-{name}").where("node <> root").withColumnRenamed("root", "low")
        joined = self.scratch.put(joined, f"joined-{name}")
        named = roots.join(_few(joined), F.col("root") == F.col("node"), "left").select("doc", F.coalesce("low", "root").alias("root"))
        self.named = self.scratch.put(named, f"named-{name}")
        return True

    def likely(self, pairs: DataFrame) -> DataFrame:
        """a, b, apart of the pairs (a, b) that their sizes and parity bits allow to be linked."""
        for c in ("a", "b"):
            pairs = pairs.join(self.heads.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")), c)
        apart = _apart(F.col("bitsa"), F.col("bitsb")).alias("apart")
        return pairs.select("a", "b", "na", "nb", apart).where(_near(F.col("na"), F.col("nb")) & (9 * F.col("apart") <= F.col("na") + F.col("nb"))).select("a", "b", "apart")

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose texts are linked. Each text of an a goes to its b, in parts of about PART texts."""
        pairs = self.scratch.put(pairs.select("a", "b"), f"pairs-{name}")
        parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).alias("parts"))
        parts = self.scratch.put(parts.where("parts > 1"), f"parts-{name}")
        dealt = pairs.join(_few(parts), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).alias("part"))
        wants = dealt.select(F.col("a").alias("doc"), "b", "part", F.lit(True).alias("later")).union(dealt.select("b", "b", "part", F.lit(False)).distinct())
        wants = self.scratch.put(wants, f"wants-{name}")
        sent = self.plain.join(_few(wants), "doc").select("b", "part", "later", "doc", "text")
        return sent.repartition("b", "part").sortWithinPartitions("b", "part", "later").mapInArrow(_compare, "a long, b long")

    def turn(self, k: int) -> bool:
        """Holds each set against the likeliest of a few sets of other components; False if nothing was joined."""
        keys = self.heads.select("doc", F.explode(F.slice("head", 1 + KEYS * k, KEYS)).alias("token"))
        keys = self.scratch.put(keys.join(_few(self.named), "doc"), f"keys{k}")
        ends = keys.groupBy("token").agg(F.min(F.struct("root", "doc")).alias("lo"), F.max(F.struct("root", "doc")).alias("hi")).where("lo.root <> hi.root")
        ends = self.scratch.put(ends, f"ends{k}")
        other = F.when(F.col("root") == F.col("lo.root"), F.col("hi.doc")).otherwise(F.col("lo.doc"))
        pairs = keys.join(_few(ends), "token").select(F.col("doc").alias("a"), other.alias("b")).distinct()
        best = self.likely(pairs).groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        done = self.merge(self.linked(best, f"turn{k}"), f"turn{k}")
        self.scratch.drop(f"keys{k}", f"ends{k}", f"wants-turn{k}", f"pairs-turn{k}")
        return done

    def rest(self) -> None:
        """Links all sets of different components that are similar."""
        shown = self.heads.join(_few(self.named), "doc").select("doc", "root", "n", F.posexplode("head").alias("pos", "token"))
        across = shown.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
        across = self.scratch.put(across, "across")
        kept = self.scratch.put(shown.join(_few(across), "token"), "kept")
        roots = kept.select("token", "root").distinct().groupBy("token").agg(F.count("*").alias("k"))
        frequent = self.scratch.put(roots.where(F.col("k") > RARE).select("token", F.lit(True).alias("often")), "frequent")
        marked = kept.join(_few(frequent), "token", "left").select("doc", "root", "n", F.struct("pos", "token", F.coalesce("often", F.lit(False)).alias("often")).alias("one"))
        by_set = marked.groupBy("doc", "root", "n").agg(F.collect_list("one").alias("shown"))  # of one head at most
        by_set = by_set.join(self.heads.select("doc", "bits"), "doc").select("doc", "root", "n", "shown", "bits")
        words = [f"b{k}" for k in range(BITS // 64)]
        rows = by_set.mapInArrow(_signatures, "sig long, kind long, doc long, root long, n long, pos long, prev long, " + ", ".join(f"{c} long" for c in OVERS) + ", " + ", ".join(f"{w} long" for w in words))
        rows = self.scratch.put(rows, "rows")
        self.scratch.drop("kept", "across")
        # an entry's largest component, where it has two at least and they may be joined by it
        per = rows.groupBy("sig", "root").agg(F.count("*").alias("k"), F.min("kind").alias("kind"))
        most = per.groupBy("sig").agg(F.count("*").alias("roots"), F.max(F.struct("k", "root")).alias("most"), F.min("kind").alias("kind")).where("roots > 1 and kind < 2")
        most = self.scratch.put(most.select("sig", F.col("most.root").alias("largest")), "most")
        packed = (F.shiftleft(F.shiftleft("n", 31) + F.col("pos"), 2) + F.col("kind")).alias("meta")
        flagged = rows.join(_few(most), "sig").select("sig", "doc", "root", packed, "prev", *OVERS, (F.col("root") == F.col("largest")).alias("big"), *words)
        flagged = self.scratch.put(flagged, "flagged")
        x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
        kind, place = (lambda z: z("meta").bitwiseAND(F.lit(3))), (lambda z: F.shiftrightunsigned(z("meta"), 2).bitwiseAND(F.lit((1 << 31) - 1)))
        n, m = F.shiftrightunsigned(x("meta"), 33), F.shiftrightunsigned(y("meta"), 33)
        room = F.least(place(x), place(y)) + F.least(n - place(x), m - place(y))
        # a pair with the same member before this one, or the same class just before this one's, has been found by that
        new = (x("prev") != y("prev")) | (x("prev") == 0)
        alone = (kind(x) == 0) & (kind(y) == 0) & (9 * room >= 4 * (n + m))
        mixed = (kind(x) > 0) & (kind(y) > 0) & ((kind(x) == 1) | (kind(y) == 1))
        for c in OVERS:
            mixed &= (x(c) != y(c)) | (x(c) == 0)
        apart = sum((F.bit_count(x(w).bitwiseXOR(y(w))) for w in words), F.lit(0))
        once = (x("root") != y("root")) & (x("big") | (x("doc") < y("doc"))) & _near(n, m) & (9 * apart <= n + m)
        pairs = flagged.alias("x").join(flagged.where("not big").alias("y"), (x("sig") == y("sig")) & once & new & (alone | mixed))
        pairs = self.scratch.put(pairs.select(F.least(x("doc"), y("doc")).alias("a"), F.greatest(x("doc"), y("doc")).alias("b")).distinct(), "found")
        self.scratch.drop("rows", "flagged", "most")
        self.merge(self.linked(pairs, "rest"), "rest")

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        rep = F.coalesce("rep", "doc")
        rows = self.base.select("doc", "n", "s1", "s2").join(self.copies, ["doc", "s1", "s2"], "left").select("doc", "n", rep.alias("rep"))
        found = rows.join(_few(self.scratch.put(self.named.where("doc <> root").toDF("rep", "root"), "moved")), "rep", "left")
        return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    join = _Join(docs)
    for k in range(TURNS):
        if not join.turn(k):
            break
    join.rest()
    return join.result()


def one_each(docs: DataFrame) -> DataFrame:
    """docs with the one document of each component that has the smallest id; its columns are unchanged."""
    keep = classes(docs).where("doc_id = component_id").select("doc_id")
    return docs.join(keep, "doc_id", "left_semi")
