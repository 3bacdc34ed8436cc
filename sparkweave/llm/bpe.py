"""BPE encoding and decoding by a merge automaton.

compile() reads the ordered merges and applies one merge gadget after the other to an automaton over tokens. It
starts with one state and a loop for each base symbol. The gadget of a merge (u, v) -> w splits the state that u
leads to: the copy has no arc v, u now leads to the copy, and every state with an arc u gets an arc w into the
state that v led to at that moment. What the automaton accepts after all merges are exactly the token sequences
that BPE produces. All arcs with one label lead to one state, so a state is kept as the difference from the state
that it was copied from: `cut[(u, v)]` is the step at which arc v was removed after u, `born[w]` the step that made
w, `parts[w]` its two labels. An arc's presence follows from those three tables (see `follows`).

A pre-split word is encoded from left to right: for each position the automaton holds the one label that be
read next, found by stepping over vocabulary entries with `follows`; the labels on the path are the ids. Decoding emits
the labels of the ids, joined by one space, as a tokenizer file without a decoder asks for.
"""

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import release, slices, texts_of

#: What a vocabulary file must ask for: composed forms, lower case, no white space, and the pattern below. Fixed values.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Printable stand-ins of bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows U+0100.
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
#: Entries that a worker remembers of words and of transitions. A full table takes no more: what
#: came first is what is common, and the rest is worked out each time.
MEMORY = 100_000
MOST = 16_000  # words that step through the tables together
_SLOTS = 1 << 18  # of the transition table
_ARCS_BITS = 19
_ARCS = 1 << _ARCS_BITS  # of the tree's arcs
_ODD = 0x9E3779B97F4A7C15


class MergeAutomaton:
    """The compiled automaton of an ordered merge list. vocab: label -> id; suffix: mark of a word's last symbol."""

    def __init__(self, vocab: dict, merges: list, suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.labels = [""] * (max(vocab.values(), default=-1) + 1)
        for label, i in vocab.items():
            self.labels[i] = label
        self.parts: dict[str, tuple[str, str]] = {}
        self.born: dict[str, int] = {}
        self.cut: dict[tuple[str, str], int] = {}
        self._known: dict = {}
        for step, (u, v) in enumerate(merges):
            self._gadget(step, u, v)
        made = set(self.born)
        self.usable = {label for label in vocab if label in made or len(label.removesuffix(suffix) if suffix else label) == 1}
        self._tables()

    def _tables(self) -> None:
        """Arrays for many words at once: the labels as a letter tree, what ends at its nodes, and known transitions."""
        heads, inner, final = {"": 0}, {}, {}
        for label in self.usable:
            ends = bool(self.suffix) and label.endswith(self.suffix) and len(label) > len(self.suffix)
            body = label[: -len(self.suffix)] if ends else label
            for k in range(1, len(body) + 1):
                heads.setdefault(body[:k], len(heads))
            for at in ([final] if ends else [inner] if self.suffix else [inner, final]):
                at[heads[body]] = self.vocab[label]
        self.width = max((ord(c) for h in heads for c in h[-1:]), default=0) + 2
        # the tree's arcs (node, letter) in a table addressed by a hash, and the node that each leads to
        self.arcs, self.to = np.full(_ARCS, -1, np.int64), np.zeros(_ARCS, np.int32)
        self.known = {heads[h[:-1]] * self.width + ord(h[-1]): node for h, node in heads.items() if h}
        for key, node in self.known.items():
            at = (key * _ODD & ((1 << 64) - 1)) >> (64 - _ARCS_BITS)
            while self.arcs[at] >= 0:
                at = (at + 1) & (_ARCS - 1)
            self.arcs[at], self.to[at] = key, node
        self.first = np.zeros(self.width, np.int32)  # arcs of the root
        for h, node in heads.items():
            if len(h) == 1:
                self.first[ord(h)] = node
        self.ends = np.full((2, len(heads)), -1, np.int32)
        for row, at in enumerate((inner, final)):
            for node, i in at.items():
                self.ends[row, node] = i
        self.size = np.array([len(x[: -len(self.suffix)] if self.suffix and x.endswith(self.suffix) and len(x) > len(self.suffix) else x) for x in self.labels], np.int32)
        self._keys, self._oks = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, bool)

    def _step(self, node, letter):
        """Nodes that the arcs (node, letter) lead to; 0 where there is none."""
        key = node.astype(np.int64) * self.width + letter
        at = ((key.view(np.uint64) * np.uint64(_ODD)) >> np.uint64(64 - _ARCS_BITS)).astype(np.int64)
        held = self.arcs[at]
        out = np.where(held == key, self.to[at], 0)
        rest = np.flatnonzero((held != key) & (held >= 0))
        while len(rest):  # what another arc stands in the place of is further on
            at[rest] = (at[rest] + 1) & (_ARCS - 1)
            held = self.arcs[at[rest]]
            hit = held == key[rest]
            out[rest[hit]] = self.to[at[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        return out

    def _gadget(self, step: int, u: str, v: str) -> None:
        if (u, v) in self.cut or not self._arc(u, v):
            return  # no path u, v is left that this merge could replace
        self.cut[(u, v)] = step
        w = u + v
        if w not in self.born:
            self.born[w], self.parts[w] = step, (u, v)

    def _arc(self, left: str, right: str) -> bool:
        """Has the state after `left` an arc `right`? The copies that `left`'s state descends from are those of its
        last parts up to the step at which each was merged away; the arc `right` stands where its first parts stood."""
        cut, born, parts = self.cut, self.born, self.parts
        before, y = len(born) + (1 << 60), left
        while True:
            limit, z = 1 << 61, right
            while True:
                step = cut.get((y, z))
                if step is not None and step < before and step <= limit:
                    return False
                if z not in parts:
                    break
                limit, z = born[z], parts[z][0]
            if y not in parts:
                return True
            before, y = born[y], parts[y][1]

    def follows(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self._known.get(key)
        if known is None:
            known = self._arc(left, right)
            if len(self._known) < MEMORY:
                self._known[key] = known
        return known

    def _allowed(self, left, right):
        """follows() of many pairs of ids, from a table addressed by a hash of the pair; a miss is worked out once."""
        keys = (left.astype(np.int64) << 32) | right
        slot = ((keys * np.int64(-7046029254386353131)) >> np.int64(44)) & np.int64(_SLOTS - 1)
        miss = self._keys[slot] != keys
        if miss.any():
            labels, known, many = self.labels, self._known, np.unique(keys[miss])
            for k, at in zip(many.tolist(), (((many * np.int64(-7046029254386353131)) >> np.int64(44)) & np.int64(_SLOTS - 1)).tolist(), strict=True):
                self._keys[at], self._oks[at] = k, self._arc(labels[k >> 32], labels[k & 0xFFFFFFFF])
            ok = self._oks[slot]
            lost = np.flatnonzero(self._keys[slot] != keys)  # two of these pairs share a slot
            for i in lost.tolist():
                k = int(keys[i])
                if k not in known:
                    known[k] = self._arc(labels[k >> 32], labels[k & 0xFFFFFFFF])
                ok[i] = known[k]
            if len(known) > MEMORY:
                known.clear()
            return ok
        return self._oks[slot]

    def encode_words(self, words: list[str], most: int = 40) -> list[bytes]:
        """Ids of each word (base symbols without the suffix) as 32-bit integers.

        All words step through the tables together: from each position, in order, along the letter tree, and where a
        label ends it becomes the one arc into that place if the transition from the label before it is allowed.
        """
        if len(words) > MOST:  # a bound of the tables below
            return [x for k in range(0, len(words), MOST) for x in self.encode_words(words[k : k + MOST], most)]
        out: list = [None] * len(words)
        whole = self.vocab
        for k, w in enumerate(words):
            if w + self.suffix in self.usable:
                out[k] = array("i", [whole[w + self.suffix]]).tobytes()
            elif len(w) > most:
                out[k] = array("i", self.encode_long(w)).tobytes()
        rest = [k for k, x in enumerate(out) if x is None]
        if not rest:
            return out
        longest = max(len(words[k]) for k in rest)
        codes = np.array([words[k] for k in rest], dtype=f"U{longest}").view(np.uint32).reshape(len(rest), longest)
        codes = np.minimum(codes, self.width - 1).astype(np.int32)
        length = np.array([len(words[k]) for k in rest], np.int32)
        last = np.full((len(rest), longest + 1), -1, np.int32)
        inner, final = self.ends
        for at in range(longest):
            rows = np.flatnonzero(length > at)
            if at:
                rows = rows[last[rows, at] >= 0]
            node = np.zeros(len(rows), np.int32)
            end = at
            while len(rows):
                node = self.first[codes[rows, end]] if end == at else self._step(node, codes[rows, end])
                end += 1
                good = node > 0
                rows, node = rows[good], node[good]
                stops = length[rows] == end
                token = np.where(stops, final[node], inner[node])
                fits = np.flatnonzero(token >= 0)
                if len(fits):
                    to, token = rows[fits], token[fits]
                    if at:
                        ok = self._allowed(last[to, at], token)
                        to, token = to[ok], token[ok]
                    last[to, end] = token
                if stops.any():
                    rows, node = rows[~stops], node[~stops]
        pieces, at, rows = [], length.copy(), np.arange(len(rest))
        if (last[rows, length] < 0).any():
            raise ValueError("a word has a symbol that is not in the vocabulary")
        count = np.zeros(len(rest), np.int32)
        while len(rows):
            token = last[rows, at[rows]]
            pieces.append((rows, token))
            count[rows] += 1
            at[rows] -= self.size[token]
            rows = rows[at[rows] > 0]
        ids = np.zeros((len(rest), len(pieces)), np.int32)
        for k, (rows, token) in enumerate(pieces):
            ids[rows, count[rows] - 1 - k] = token
        raw, step = ids.tobytes(), 4 * len(pieces)
        for k, (i, n) in enumerate(zip(rest, count.tolist(), strict=True)):
            out[i] = raw[k * step : k * step + 4 * n]
        return out

    def encode_long(self, word: str) -> list[int]:
        """Ids of one word of any length, by the same transitions, in time proportional to it."""
        n, last = len(word), [-1] * (len(word) + 1)
        inner, final = self.ends
        get = self.known.get
        for at in range(n):
            if at and last[at] < 0:
                continue
            node, end = 0, at
            while end < n:
                node = get(node * self.width + min(ord(word[end]), self.width - 1), 0)
                end += 1
                if not node:
                    break
                token = int(final[node] if end == n else inner[node])
                if token >= 0 and (not at or self.follows(self.labels[last[at]], self.labels[token])):
                    last[end] = token
        if n and last[n] < 0:
            raise ValueError("a word has a symbol that is not in the vocabulary")
        out, at = [], n
        while at:
            out.append(last[at])
            at -= int(self.size[last[at]])
        return out[::-1]


def _gathered(flat, first, count, pick):
    """The runs flat[first:first + count] of the picked entries, one after the other, and where each begins."""
    size = count[pick]
    ends = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(first[pick] - ends[:-1], size)
    take += np.arange(len(take))
    return flat[take], ends


def _picked(parts: list[bytes], pick):
    count = np.array(list(map(len, parts)), np.int64) // 4
    return _gathered(np.frombuffer(b"".join(parts), "<i4"), np.cumsum(count) - count, count, pick)


class Encoder:
    """Texts to ids and back, with a bounded memory of chunks between white space."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, split = spec["normalizer"] or {}, (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if [n["type"] for n in normal.get("normalizers", [])] != _NORMAL or split[0].get("pattern") != {"Regex": _PATTERN} or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path}: not a vocabulary of lower-case words without white space")
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = self.automaton.labels
        top = max([len(labels) - 1, *self.special.values()])
        self.labels = labels + [""] * (top + 1 - len(labels))
        for text, i in self.special.items():
            self.labels[i] = text
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._labels = pa.array(self.labels, pa.string())
        self._memory: dict[str, bytes] = {}

    def _hard(self, chunk: str) -> bytes:
        """Ids of a chunk as the library splits it, special tokens as they stand."""
        words = []
        for part in self._cut.split(chunk) if self._cut and "<|" in chunk else [chunk]:
            words += [self.special[part]] if part in self.special else [w for w, _ in self.split(self.normal(part))] if part else []
        ids = iter(self.automaton.encode_words([w for w in words if w.__class__ is str]))
        return b"".join([next(ids) if w.__class__ is str else array("i", [w]).tobytes() for w in words])

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct lower-case words. What the memory lacks is worked out together."""
        memory = self._memory
        found = list(map(memory.get, words))
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            plain = [w if (w := words[k]).isascii() else w.encode().decode("latin-1").translate(_BYTES) for k in new]
            for k, x in zip(new, self.automaton.encode_words(plain), strict=True):
                found[k] = x
            for k in new[: MEMORY - len(memory)]:
                if len(words[k]) <= 40:
                    memory[words[k]] = found[k]
        return found

    def _chunks(self, chunks):
        """Ids of distinct chunks without white space, as one flat array, and of each chunk the first and the number.

        Printable ASCII without apostrophes and the letters of Latin-1 are lowered and split here, all chunks together:
        runs of letters, single digits, runs of the rest. Other chunks are the library's to split.
        """
        data, at = texts_of(chunks)
        lead = data == 0xC3
        second = np.zeros(len(data), bool)
        second[1:] = lead[:-1]
        sign = second & ((data == 0x97) | (data == 0xB7))  # the two signs among the letters
        mark = np.zeros(len(data), bool)
        mark[:-1] = (data[:-1] == 60) & (data[1:] == 124)  # may be a special token
        plain = ((data > 32) & (data < 127) & (data != 39) & ~mark) | lead | (second & ~sign)
        size = np.diff(at)
        hard = np.diff(np.concatenate([[0], np.cumsum(~plain)])[at]) > 0
        keep = np.repeat(~hard, size)
        low = data.copy()
        low[((data >= 65) & (data <= 90)) | (second & (data < 0x9F))] += 32
        low, kind = low[keep], np.where(lead | second | ((low >= 97) & (low <= 122)), 1, np.where((data >= 48) & (data <= 57), 2, 3))[keep]
        starts = np.ones(len(low), bool)
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        first = np.cumsum(np.where(hard, 0, size)) - np.where(hard, 0, size)
        starts[first[~hard]] = True
        starts = np.flatnonzero(starts)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(low)).astype(np.int64)), pa.py_buffer(low)).dictionary_encode()
        flat, ends = _picked(self._ids(words.dictionary.to_pylist()), words.indices.to_numpy())
        begin = ends[np.searchsorted(starts, first)]
        count = ends[np.searchsorted(starts, first + np.where(hard, 0, size))] - begin
        rest = [self._hard(c) for c in chunks.filter(pa.array(hard)).to_pylist()]
        count[hard] = [len(x) // 4 for x in rest]
        begin[hard] = len(flat) + np.cumsum(count[hard]) - count[hard]
        return np.concatenate([flat, np.frombuffer(b"".join(rest), "<i4")]), begin, count

    def encode(self, texts):
        """Ids of all texts of an Arrow string array, and where each text's ids begin (one entry more than texts).

        Chunks between white space are worked out once for each distinct one; Arrow names their places.
        """
        data, at = texts_of(texts)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = at[:-1][at[1:] > at[:-1]]
        begins[cut] = inside[cut]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        solid = data[inside]
        where = np.append((np.cumsum(inside) - 1)[starts], len(solid)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(solid)).dictionary_encode()
        flat, first, count = self._chunks(coded.dictionary)
        ids, ends = _gathered(flat, first, count, coded.indices.to_numpy())
        return ids, ends[np.searchsorted(starts, at)]

    def decode(self, ids, where) -> pa.Array:
        """Texts of lists of ids (one flat array, and where each list begins): the arcs' labels joined by one space."""
        labels = self._labels.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(where, pa.int32()), labels), " ")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One compiled encoder for each vocabulary file and Python worker."""
    made = Encoder(path)
    release()
    return made


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, decode: bool = False) -> DataFrame:
    """ids (array of int) of each whole text, and with decode the text that those ids decode to.

    keep: columns that pass through. Null texts count as empty; empty texts have no ids and decode to the empty
    string. Repeated rows are encoded alike. Columns other than `keep` and `text` are not read.
    """
    keep = [] if keep is None else keep
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    schema += (", " if keep else "") + "ids array<int>" + (", decoded string" if decode else "")

    def run(batches):
        model = encoder(path)
        for batch in batches:
            column = batch.column(len(keep))
            for first, last in slices(column, 2 << 20):
                ids, where = model.encode(column.slice(first, last - first))
                arrays = [batch.column(k).slice(first, last - first) for k in range(len(keep))]
                arrays.append(pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(ids)))
                if decode:
                    arrays.append(model.decode(ids, where))
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "ids", *["decoded"] * decode])
            release()

    return df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(text)).mapInArrow(run, schema)
