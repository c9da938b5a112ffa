"""Importance resampling against a plain version of its definition."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from gameline.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, target, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) by the definition, joined strings and all."""
    def features(text):
        w = words(text)
        return [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    has, wanted = Counter(), Counter()
    for _, text in docs:
        has.update(features(text))
    for text in target:
        wanted.update(features(text))
    s_all, t_all = sum(has.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((has[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= 20])
    fits = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): n + 1 for n, r in enumerate(fits[:25 * len(fits) // 100])}
    return sorted([(str(r[0]), *r[1:4], rank.get(id(r))) for r in out], key=str)


def got(df):
    return sorted([(str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()], key=str)


def test_whole_table(spark, data, documents):
    bench = pd.read_parquet(f"{data}/benchmark.parquet")
    want = plain(list(zip(documents.doc_id.tolist(), documents.text)), bench.text)
    assert got(importance.op13(spark, data)) == want
    assert sum(r[4] is not None for r in want) == 25 * sum(len(words(t)) >= 20 for t in documents.text) // 100


@pytest.mark.parametrize("piece", [7, 1 << 16])
def test_pieces_cut_no_word(piece):
    text = "Ab cd " * 9 + "x" * 40 + "É漢字 A1-b2\0C\n" * 5 + "end"
    w = words(text)
    want = sorted(zlib.crc32(f.encode()) for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    count, hashes = importance.feature_hashes(text, 2, piece)
    assert count == len(w) and sorted(hashes) == want
    low = importance.lowered(text)
    assert [low[a:b] for found in importance.words(text, piece) for _, (a, b) in found] == w
    spans = [" ".join(words(low[a:b])) for a, b in importance.feature_spans(text)]
    assert sorted(zlib.crc32(f.encode()) for f in spans) == want


def test_awkward_rows(spark, make, awkward):
    rows = awkward + [(20 + i, "one word after another " * 6) for i in range(9)]
    target = spark.createDataFrame([(1, "another word"), (2, None), (None, "")], "item_id long, text string")
    assert got(importance.resample(make(rows), target)) == plain([(i, t) for i, t in rows], ["another word", None, ""])
    none = make([])
    assert importance.resample(none, target).count() == 0
    assert got(importance.resample(make(rows), target.limit(0))) == plain([(i, t) for i, t in rows], [])


def test_drawn_lean_to_the_target(spark, make):
    rows = [(i, ("old bridge over the river " if i % 2 else "stock market prices today ") * 8) for i in range(400)]
    target = spark.createDataFrame([(i, "the old bridge over the quiet river") for i in range(200)], "item_id long, text string")
    kept = importance.drawn(make(rows), target)
    assert kept.columns == make(rows).columns and kept.count() == 100
    assert kept.where("text like 'old%'").count() > 90
