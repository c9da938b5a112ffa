"""Exact search against all scores, mixing against its own definition."""

import math

import numpy as np
import pytest

from gameline.llm import mixing, va_file


def brute(vectors, queries, k):
    out = set()
    for q in {i for i, _ in queries}:
        v = max(v for i, v in queries if i == q)
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v)))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("bits,block_rows,query_rows", [(2, 50, 7), (6, 4096, 1024)])
def test_top_k_equals_all_scores(spark, bits, block_rows, query_rows):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.integers(-200, 200, 8).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[i % 5][1]) for i in range(60)]  # ties
    vectors += [(2000 + i, rng.integers(-9, 9, 3).tolist()) for i in range(4)]  # fewer than k, another length
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    queries = df.where("vec_id % 10 = 0 or vec_id >= 2000")
    got = va_file.top_k(va_file.build(df, bits, block_rows), queries, 5, query_rows)
    want = brute(vectors, [(i, v) for i, v in vectors if i % 10 == 0 or i >= 2000], 5)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == want


def test_search_reads_few_exact_vectors():
    rng = np.random.default_rng(3)
    v = rng.integers(-128, 128, (4000, 32))
    cuts = np.sort(v, axis=0)[np.linspace(0, len(v) - 1, 65).astype(int)].T
    cells = np.stack([np.clip(np.searchsorted(cuts[d], v[:, d], side="right") - 1, 0, 63) for d in range(32)], axis=1).astype(np.uint8)
    found, read = va_file.scan_block(v[:50], np.arange(50), np.arange(4000), cells, cuts, v, 5)
    assert len(found) == 250 and read < 0.1 * 50 * 4000


def test_search_on_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, []), (None, [1.0, 1.0]), (50, [0.5, 0.5]),
            (7, [-0.001, 0.3]), (7, [-0.001, 0.3]), (100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "'x' AS block", "2 AS size")
    vectors = va_file.integer_vectors(df)
    assert {(r.vec_id, tuple(r.v)) for r in vectors.collect()} == {(0, (256, 128)), (50, (128, 128)), (7, (-1, 76)), (100, (256,))}
    got = va_file.top_k(va_file.build(vectors), vectors.where("vec_id % 50 = 0"))
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == [
        (0, 1, 50, 49152), (0, 2, 7, 9472), (0, 3, 7, 9472), (50, 1, 0, 49152), (50, 2, 7, 9600), (50, 3, 7, 9600)]
    none = va_file.integer_vectors(df.where("false"))
    assert va_file.top_k(va_file.build(none), none).count() == 0


def test_exponent_meets_the_targets():
    tokens = [70_000, 5_000, 3_000, 2_000]
    total = sum(tokens)
    a = mixing.bisect_exponent(tokens, total, entropy=0.9, max_repeats=None)
    h = mixing.entropy_of(mixing.weights_at(tokens, a)) / math.log(4)
    assert abs(h - 0.9) < 1e-9
    a = mixing.bisect_exponent(tokens, total, entropy=None, max_repeats=3.0)
    w = mixing.weights_at(tokens, a)
    assert abs(max(x * total / t for x, t in zip(w, tokens)) - 3.0) < 1e-9
    both = mixing.bisect_exponent(tokens, total, entropy=0.9, max_repeats=3.0)
    assert both == max(a, mixing.bisect_exponent(tokens, total, 0.9, None))
    assert mixing.bisect_exponent([5], 5) == 1.0 and mixing.bisect_exponent([], 0) == 1.0
    assert mixing.weights_at([1, 0, 3], 0.0) == [0.5, 0.0, 0.5]


@pytest.mark.parametrize("block_tokens", [mixing.BLOCK_TOKENS, 50])
def test_budgets_are_met(spark, make, rows, block_tokens):
    given = [(i, "w " * (i % 9 + 1), "big") for i in range(400)] + [(1000 + i, "w " * 5, "small") for i in range(20)] + [
        (2000 + i, "w " * 4, None) for i in range(10)]
    docs = make(given)
    plan = {r.source: r for r in mixing.plan_weights(mixing.sizes(docs)).collect()}
    got = rows(mixing.draw(mixing.sizes(docs), block_tokens=block_tokens))
    assert abs(sum(p.weight for p in plan.values()) - 1) < 1e-12
    largest = {"big": 9, "small": 5, None: 4}
    for source, p in plan.items():
        own = got[got.source.isna()] if source is None else got[got.source == source]
        assert p.budget <= own.tokens.sum() < p.budget + largest[source]
        copies = own.groupby("id").size()
        assert copies.max() - copies.min() <= 1 or len(copies) < 10
        assert not own.duplicated(["id", "mix_pass"]).any()
    again = rows(mixing.draw(mixing.sizes(docs).repartition(7), block_tokens=block_tokens))
    key = ["id", "mix_pass"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_mixing_awkward_rows(make, awkward, rows):
    docs = make(awkward)
    got = rows(mixing.mix(docs))
    assert set(docs.columns) | {"mix_pass", "mix_block", "mix_key"} == set(got.columns)
    # one source: the natural mixture is the table itself
    assert sorted(map(str, zip(got.doc_id, got.text))) == sorted(str((float(i) if i is not None else float("nan"), t)) for i, t in awkward)
    assert mixing.mix(make([])).count() == 0
    assert mixing.mix(make([(1, ""), (2, None)])).count() == 0  # a source without tokens is not drawn
