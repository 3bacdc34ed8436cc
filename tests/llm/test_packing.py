"""Packing: every piece once, gapless places, few sequences."""

import zlib

import numpy as np
import pyarrow as pa

from sparkweave.llm import bpe, packing
from sparkweave.llm.tables import Scratch, vocabulary


def test_local_search_fills_bins():
    rng = np.random.default_rng(0)
    for low, high in ((1, 4095), (1, 3000), (1500, 2600)):
        lengths = rng.integers(low, high, 1500)
        number, offset = packing.pack(lengths)
        fill = np.bincount(number, weights=lengths)
        assert fill.max() <= 4096 and len(fill) <= 1.03 * -(-lengths.sum() // 4096)
        for b in range(0, len(fill), 50):
            mine = np.flatnonzero(number == b)
            mine = mine[np.argsort(offset[mine])]
            assert (offset[mine] == np.cumsum(lengths[mine]) - lengths[mine]).all()
    assert len(packing.pack([])[0]) == 0
    # two bins of 6 and 6 of 10 take 7 + 3 and 5 + ... only by an exchange
    assert len(set(packing.pack([6, 6, 4, 4], 10)[0].tolist())) == 2


def test_documents(spark):
    rows = [(k, "word " * (37 * k % 900), "x") for k in range(200)] + [(500, None, "x"), (501, "", "x"), (502, "long text " * 9000, "x"), (502, "long text " * 9000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    parts = Scratch(spark, "test").put(packing.pieces(docs, vocabulary()), "pieces")
    got = packing.place(parts, group=60).toPandas()
    ids, where = bpe.encoder(vocabulary()).encode(pa.array([t for _, t, _ in rows], pa.string()))
    assert got.length.sum() == len(ids) + len(rows)
    first = got[(got.doc_id == 502) & (got.piece == 0)].iloc[0]
    assert first.length == 4096 and first.ids_crc32 == zlib.crc32(ids[where[-2] :][:4096].astype("<i4").tobytes())
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= 4096
    assert packing.place(packing.pieces(docs.limit(0), vocabulary())).count() == 0


def test_no_pair_of_bins_has_a_step_left():
    for low, high, n in ((800, 2500, 1500), (1500, 3500, 1500), (1, 1200, 600)):
        lengths = np.random.default_rng(3).integers(low, high, n)
        number, _ = packing.pack(lengths)
        fill = np.bincount(number, weights=lengths).astype(int)
        members = [lengths[number == b].tolist() for b in range(len(fill))]
        under = [b for b in range(len(fill)) if fill[b] < 4096]
        assert fill.max() <= 4096
        for b in under:
            mine = members[b]
            pairs = {x + y for i, x in enumerate(mine) for y in mine[i + 1 :]} | set(mine)
            for a in under:
                if a != b and fill[a] >= fill[b]:
                    free = 4096 - fill[a]
                    assert min(mine) > free
                    assert not any(0 < s - x <= free for s in pairs for x in members[a])
