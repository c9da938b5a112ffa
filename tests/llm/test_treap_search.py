"""Ranked search over treaps against scores of every document."""

import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gameline.llm import treap_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """Sorted (item_id, rank, doc_id, score) by the definition, every document scored."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            if not b:
                continue
            m = 100 - 90 + (90 * b.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m))
                        for t in set(terms(text)) if t in b)
            if score > 0:
                scored.append((-score, i is None, i, i))
        out += [(str(item), r + 1, str(i), -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def got(df):
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in df.collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 200, 60), (500, 37, 900), (64, 64, 4096), (1, 40, 20), (70, 1, 30)])
def test_squares_keep_every_point(shape):
    n_rows, n_cols, n = shape
    rng = np.random.default_rng(sum(shape))
    cells = rng.choice(n_rows * n_cols, min(n, n_rows * n_cols), replace=False)
    rows, cols = np.divmod(cells, n_cols)
    impacts = rng.integers(0, 1000, len(cells))
    t = treap_search.treap(rows, cols, impacts)
    assert sorted(zip(t["leaf_rows"].tolist(), t["leaf_cols"].tolist())) == sorted(zip(rows.tolist(), cols.tolist()))
    packed = [t["levels"].astype("<i8").tobytes(), t["masks"].tobytes(), t["lacks"].astype("<i4").tobytes(), t["top"],
              t["leaf_rows"].astype("<u4").tobytes(), t["leaf_cols"].astype("<u2").tobytes()]
    block = treap_search.Block(np.arange(n_cols, dtype="<i8").tobytes(), [f"t{r:03d}" for r in range(n_rows)], *packed)
    leaves = (block.leaf_rows, block.leaf_cols, block.best[block.masks == 0])
    best = {(r, c): v for r, c, v in zip(*(x[:-1].tolist() for x in leaves))}  # the last stands for no square
    assert best == {(r, c): v for r, c, v in zip(rows.tolist(), cols.tolist(), impacts.tolist())}
    for asked in ([0], list(range(min(n_rows, 20))), [n_rows - 1, 0][:n_rows]):
        weights = [1 + a % 7 for a in asked]
        scores = Counter()
        for r, c, v in zip(rows.tolist(), cols.tolist(), impacts.tolist()):
            scores[c] += sum(w * v for a, w in zip(asked, weights) if a == r)
        want = sorted(((s, c) for c, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1]))
        assert block.search([f"t{a:03d}" for a in asked], weights, 5) == want[:5]
        floor = want[2][0] if len(want) > 2 else 1
        assert block.search([f"t{a:03d}" for a in asked], weights, 5, floor) == [x for x in want[:5] if x[0] >= floor]


def test_search_opens_few_ranges():
    rng = np.random.default_rng(1)
    n_rows, n_cols = 400, 2048
    rows, cols = np.divmod(rng.choice(n_rows * n_cols, 40_000, replace=False), n_cols)
    planted = np.unique(np.concatenate([rows * n_cols + cols, np.arange(30) * n_cols + 777]))
    rows, cols = np.divmod(planted, n_cols)
    t = treap_search.treap(rows, cols, np.where(cols == 777, 900, rng.integers(100, 600, len(rows))))
    block = treap_search.Block(b"\0" * 8 * n_cols, [str(r) for r in range(n_rows)], t["levels"].astype("<i8").tobytes(), t["masks"].tobytes(),
                               t["lacks"].astype("<i4").tobytes(), t["top"], t["leaf_rows"].astype("<u4").tobytes(), t["leaf_cols"].astype("<u2").tobytes())
    opened = []
    halves = block._halves
    block._halves = lambda *a: opened.append(len(a[0])) or halves(*a)
    assert block.search([str(r) for r in range(30)], [1] * 30, 1)[0][1] == 777
    assert sum(opened) < n_cols / 2


@pytest.mark.parametrize("shape", [(2, 1 << 20, 1 << 20), (5, 3000, 0), (4096, 4 << 20, 1 << 20)])
def test_awkward_rows(spark, make, awkward, shape):
    docs, size, broadcast = shape
    rows = awkward + [(100 + i, "one two " * (i % 3 + 1) + f"w{i % 4}") for i in range(60)] + [(7, "Seven SEVEN sevEN É é")] * 2
    items = [(1, "one two seven"), (1, "one two seven"), (2, None), (3, "nothing known"), (None, "w1 w2 one É Words"), (4, ""), (5, "words 漢字 a")]
    given = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "'x' AS term")
    grid = treap_search.grids(make(rows).repartition(3), block_docs=docs, block_bytes=size)
    n_docs, n_terms = grid.selectExpr("sum(n_docs)", "sum(n_terms)").first()
    found = treap_search.search(treap_search.build(grid, n_docs, n_terms), treap_search.weighted_items(grid, given, n_docs),
                                group_items=2, spread=3, broadcast_bytes=broadcast)
    assert got(found) == plain(rows, items)


def test_empty_tables(spark, make, awkward):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert treap_search.rank_documents(make([]), items).count() == 0
    assert treap_search.rank_documents(make([(1, None), (2, "")]), items).count() == 0
    assert treap_search.rank_documents(make(awkward), items.limit(0)).count() == 0


def test_long_texts_are_read_in_parts():
    text = "Ab cd-" * 50 + "x" * 90 + " É漢 b" * 9
    assert {t.decode(): n for t, n in treap_search.terms_of(text, 11).items()} == dict(Counter(terms(text)))


def test_points_wait_as_small_arrays():
    words = " ".join(f"word{i}" for i in range(2000))
    batch = pa.record_batch([pa.array(range(100), pa.int64()), pa.array([f"{words} own{i}" for i in range(100)])], names=["doc_id", "text"])
    tracemalloc.start()
    try:
        blocks = list(treap_search._grids(iter([batch]), 100, 1 << 30))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [len(b.column("rows")[0].as_py()) for b in blocks] == [4 * 100 * 2001]
    assert most < 36 * 100 * 2001  # bytes; a counter of each document takes over a hundred a point


def test_a_task_gets_a_few_blocks_at_a_time(spark, make, monkeypatch):
    monkeypatch.setattr(treap_search, "ROW_GROUP_BYTES", 1 << 19)
    monkeypatch.setattr(treap_search, "BATCH_BYTES", 1 << 19)
    rows = make([(i, " ".join(f"w{i}x{j}" for j in range(20_000))) for i in range(12)]).coalesce(1)
    before = spark.conf.get(treap_search.BATCH_SETTING)
    grid = treap_search.grids(rows, block_docs=1)
    index = treap_search.build(grid, 12, 240_000)
    assert spark.conf.get(treap_search.BATCH_SETTING) == before
    for made in (grid, index):  # some 0.4 MB a block
        groups = sum(pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups for f in made.inputFiles())
        assert groups >= 4

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    counted = [r.n for r in treap_search.written(index.coalesce(1).mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(counted) == 12 and len(counted) >= 4
