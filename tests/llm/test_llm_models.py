"""Held-out accuracy of the classifiers, and the language model against its definition."""

import math
import os
import re
import zlib
from collections import Counter
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pytest

from gameline.llm import common, factor_machine, subword_toxicity, suffix_tree

CLEAN = "the quiet river runs under an old bridge while people walk along its banks in the evening light".split()


def text(rng, n, bad=()):
    words = [CLEAN[i] for i in rng.integers(0, len(CLEAN), n)]
    for w in bad:
        words[rng.integers(0, n)] = w
    return " ".join(words)


@pytest.fixture(scope="module")
def toxic_rows():
    rng = np.random.default_rng(5)
    return [(i, text(rng, 60, ["idiotic", "moronic", "idiotic"] if i % 3 == 0 else ()), int(i % 3 == 0)) for i in range(600)]


def test_unseen_misspellings_share_subwords(spark, make, toxic_rows, rows):
    rng = np.random.default_rng(6)
    docs = make([r[:2] for r in toxic_rows])
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in toxic_rows], "doc_id long, toxic int, quality int")
    model = subword_toxicity.train(docs, labels)
    new = [(9001, text(rng, 60, ["idiotik", "moronik", "idiotikk"])), (9002, text(rng, 60)), (9003, None), (9004, ""),
           (9005, text(rng, 5000)), (9006, text(rng, 4000) + " " + text(rng, 40, ["idiotic"] * 4)), (None, "x"), (9001, "x")]
    got = rows(subword_toxicity.score(make(new), model))
    assert len(got) == len(new) and got.score.between(0, 1).all()
    score = dict(zip(got.doc_id.dropna(), got.score))
    first = got[(got.doc_id == 9001)].score.max()
    assert first > 0.5 and score[9006] > 0.5
    assert max(score[i] for i in (9002, 9003, 9004, 9005)) < 0.5


def accuracy(got, labels, label):
    m = got.merge(labels[["doc_id", label]], on="doc_id")
    m = m[m.held_out]
    assert len(m) > 100
    return float((m.predicted == m[label]).mean()), float(m[label].mean())


BIG = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark, rows):
    got = rows(subword_toxicity.op3(spark, BIG))
    found, share = accuracy(got, pd.read_parquet(f"{BIG}/labels.parquet"), "toxic")
    assert found > 0.94 and found > 1 - share
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()


def test_quality_held_out(spark, rows):
    got = rows(factor_machine.op8(spark, BIG))
    found, _ = accuracy(got, pd.read_parquet(f"{BIG}/labels.parquet"), "quality")
    assert found > 0.98 and got.score.between(0, 1).all()
    assert got.predicted.tolist() == (got.score >= 0.3).astype(int).tolist()


def test_interactions_are_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    n = factor_machine.BUCKETS + factor_machine.STATISTICS
    m = factor_machine.FactorMachine(0.3, rng.normal(size=n), rng.normal(size=(n, 4)) / 4, np.zeros(factor_machine.STATISTICS),
                                     np.ones(factor_machine.STATISTICS))
    bucket, value, stats = factor_machine.inputs("some words and some more words", None)
    x = np.concatenate([value, m.scaled(stats)])
    at = np.concatenate([bucket, np.arange(factor_machine.BUCKETS, n)])
    pairs = sum(m.factors[at[a]] @ m.factors[at[b]] * x[a] * x[b] for a in range(len(x)) for b in range(a))
    assert math.isclose(m.logit(bucket, value, stats), 0.3 + m.weights[at] @ x + pairs, rel_tol=1e-6)


def test_classifiers_without_labels_and_on_awkward_rows(spark, make, awkward, rows):
    docs, none = make(awkward), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (factor_machine, subword_toxicity):
        got = rows(module.score(docs, module.train(docs, none)))
        assert len(got) == len(awkward) and (got.score == 0.5).all()
        assert module.score(make([]), module.train(make([]), none)).count() == 0
    kept = factor_machine.keep_good(docs, factor_machine.train(docs, none))
    assert kept.columns == docs.columns and kept.count() == len(awkward)
    odd = spark.createDataFrame([(1, None, 1), (None, 1, 0), (4, 0, 1), (4, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    for module in (factor_machine, subword_toxicity):
        assert rows(module.score(docs, module.train(docs, odd))).score.between(0, 1).all()


def tokens_of(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\n"]


def base_scores(given):
    train = [tokens_of(t) for i, t in given if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = Counter(w for x in train for w in x)
    n, v = sum(c.values()), len(c)
    return [(len(x), sum(w in c for w in x), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x))
            for x in (tokens_of(t) for _, t in given)]


def test_op2_whole_table(spark, data, documents, rows):
    got = rows(suffix_tree.op2(spark, data)).sort_values("doc_id")
    want = base_scores(list(zip(documents.doc_id, documents.text)))
    assert got.n_tokens.tolist() == [w[0] for w in want]
    assert got.n_known.tolist() == [w[1] for w in want]
    assert set(got.train_tokens) == {want[0][2]}
    assert np.allclose(got.base_score, [w[3] for w in want], rtol=1e-9)
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 1 for i in got.doc_id]
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()  # the tree adds to word frequencies on texts it has not seen


def brute_logs(rows_, data):
    """log10 of each byte by the longest retained suffix, straight from the distributions."""
    known = suffix_tree._distributions(rows_)
    out = []
    for i in range(2, len(data)):
        before = bytes(data[:i])
        s = next(before[len(before) - k:] for k in range(suffix_tree.DEPTH, -1, -1) if k <= i and before[len(before) - k:] in known)
        out.append(math.log10(known[s][data[i]]))
    return out


def test_automaton_uses_the_longest_retained_suffix(spark, make, rows):
    given = [(i, "banana bandana cabana " * 20 + f"word{i} é") for i in range(30)]
    docs = common.texts(make(given))
    for share, bits in ((1e-3, 0.01), (0.02, 0.3)):
        words, tree, total, distinct = suffix_tree.train(docs, share, bits)
        counted = Counter()
        tokens = suffix_tree.Tokens.of([t for _, t in given])
        grams = spark.createDataFrame([(int(g), 1) for g in tokens.grams().tolist()], "key long, n long")
        kept = [(r.length, r.context, r.byte, r.n) for r in suffix_tree.retained(grams, share, bits).collect()]
        assert tree.contexts == len({(r[0], r[1]) for r in kept}) > 1
        some = suffix_tree.Tokens.of(["a banana! in cabana", "", "unseen ß bytes"]).data
        assert np.allclose(tree.logs(some), brute_logs(kept, some.tolist()), atol=1e-4)
    del counted


def test_language_model_awkward_rows(spark, make, awkward, rows):
    docs = common.texts(make(awkward))
    words, tree, total, distinct = suffix_tree.train(docs.where(common.fold(docs.doc_id) != 1))
    got = rows(suffix_tree.score(docs, words, tree, total, distinct, block_bytes=4000))
    want = base_scores(awkward)
    key = lambda n, k, b: (n, k, round(b, 6))
    assert sorted(key(*r) for r in zip(got.n_tokens, got.n_known, got.base_score)) == sorted(key(n, k, b) for n, k, _, b in want)
    assert np.isfinite(got.score).all() and (got.score < 0).all()
    none = common.texts(make([]))
    words, tree, total, distinct = suffix_tree.train(none)
    assert (total, distinct) == (0, 0) and suffix_tree.score(none, words, tree, total, distinct).count() == 0
    assert suffix_tree.score(docs, words, tree, total, distinct).count() == len(awkward)


def test_rare_context_stays_when_the_corpus_grows(spark):
    key = lambda b: int.from_bytes(b, "big")
    for rest in (1_000, 10_000_000):
        grams = spark.createDataFrame([(key(b"abcdefgx"), 20), (key(b"zzzzzzzy"), rest)], "key long, n long")
        assert (1, ord("g"), ord("x"), 20) in [tuple(r) for r in suffix_tree.retained(grams).collect()]


def test_stored_tables_are_smaller_than_the_texts(spark, monkeypatch):
    written, stored = [], suffix_tree.stored

    def measured(df, *args, **options):
        out = stored(df, *args, **options)
        written.append(sum(os.path.getsize(unquote(urlparse(f).path)) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(suffix_tree, "stored", measured)
    docs = common.texts(common.table(spark, BIG, "documents"))
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert suffix_tree.score(docs, *suffix_tree.train(docs), block_bytes=8 << 20).count() == docs.count()
    assert 0 < sum(written) < 1.2 * size


def test_blocks_do_not_change_scores(spark, make, awkward, rows):
    docs = common.texts(make(awkward))
    model = suffix_tree.train(docs)
    key = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    whole, parts = (rows(suffix_tree.score(docs, *model, block_bytes=n)).sort_values(key)[key].reset_index(drop=True) for n in (24 << 20, 100))
    assert whole.equals(parts)


def test_no_context_reaches_into_another_document():
    texts_ = ["first text.", "", "second text"]
    alone = [suffix_tree.Tokens.of([t]).grams() for t in texts_]
    assert suffix_tree.Tokens.of(texts_).grams().tolist() == np.concatenate(alone).tolist()


def test_words_glued_into_one_token_are_read(spark, make, toxic_rows, rows):
    rng = np.random.default_rng(7)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in toxic_rows], "doc_id long, toxic int, quality int")
    model = subword_toxicity.train(make([r[:2] for r in toxic_rows]), labels)
    clean, toxic = text(rng, 60), text(rng, 60, ["idiotic"] * 8)
    new = [(1, clean.replace(" ", "_")), (2, toxic.replace(" ", "_")), (3, f"{clean} {toxic.replace(' ', '/')} {clean}")]
    got = rows(subword_toxicity.score(make(new), model)).set_index("doc_id").score
    assert got[1] < 0.5 < min(got[2], got[3])
    assert len(subword_toxicity.words_of("x" * 64)) == 1
    long = "".join(chr(0x4e00 + i) for i in range(203))
    parts = subword_toxicity.words_of(long)
    assert all(any(long[i:i + 5] in part for part in parts) for i in range(199))
