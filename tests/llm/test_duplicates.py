"""Exact and near duplicates against brute force."""

import hashlib
import random

import pytest

from gameline.llm import banded_jaccard, radix_dedup
from gameline.llm.components import components


def test_equal_groups_are_the_texts():
    rng = random.Random(1)
    base = b"prefix shared by many texts " * 20
    texts = [base + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 3))) for _ in range(200)] + [b"", b""]
    groups = radix_dedup.equal_groups(texts)
    assert sorted(i for g in groups for i in g) == list(range(len(texts)))
    assert len(groups) == len(set(texts)) and all(len({texts[i] for i in g}) == 1 for g in groups)


def exact(given):
    by = {}
    for i, t in given:
        by.setdefault(t or "", []).append(i)
    out = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        stays = True
        for i in ids:
            out.append((str(i), str(keep), len(ids), i == keep and stays))
            stays = stays and i != keep
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in df.collect())


@pytest.mark.parametrize("group_bytes", [radix_dedup.GROUP_BYTES, 1])
def test_exact_awkward(spark, make, awkward, group_bytes):
    marked = radix_dedup.duplicates(make(awkward), group_bytes=group_bytes)
    assert found(marked) == exact(awkward)


@pytest.mark.parametrize("group_bytes", [radix_dedup.GROUP_BYTES, 2000])
def test_exact_hot_groups_and_prefixes(spark, make, group_bytes):
    hot = "the same long beginning of many documents " * 30
    given = [(i, hot) for i in range(300)] + [(1000 + i, hot[:-8] + f"{i % 40:08d}") for i in range(200)]
    marked = radix_dedup.duplicates(make(given).repartition(16), group_bytes=group_bytes)
    assert found(marked) == exact(given)


def test_exact_rows_that_stay(make, awkward, spark):
    docs = make(awkward)
    stay = radix_dedup.deduplicate(docs)
    assert stay.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in stay.collect()) == sorted(
        (str(max((i for i, u in awkward if (u or "") == t and i is not None), default=None)), t) for t in {u or "" for _, u in awkward})
    assert radix_dedup.deduplicate(make([])).count() == 0


def test_digest_of_whole_text(spark, data, documents):
    got = {r.doc_id: r.text_sha256 for r in radix_dedup.op5(spark, data).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in zip(documents.doc_id, documents.text)}


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(given, threshold=0.8):
    sets = [grams(t) for _, t in given]
    part = [i is not None and bool(s) for (i, _), s in zip(given, sets)]
    links = [[b for b in range(len(given)) if b != a and part[a] and part[b]
              and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9] for a in range(len(given))]
    seen, out = {}, []
    for a in range(len(given)):
        if a in seen:
            continue
        todo, comp = [a], {a}
        while todo:
            for b in links[todo.pop()]:
                if b not in comp:
                    comp.add(b)
                    todo.append(b)
        for b in comp:
            seen[b] = comp
    for a, (i, _) in enumerate(given):
        same = [given[b][0] for b in range(len(given)) if part[a] and part[b] and sets[a] == sets[b]]
        out.append((str(i), str(min(given[b][0] for b in seen[a]) if part[a] else i), str(min(same) if same else i), len(links[a])))
    return sorted(out)


def near_found(df):
    return sorted((str(r.doc_id), str(r.class_id), str(r.set_id), r.n_links) for r in df.collect())


def variants(n, edits, seed, words=120):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 9999)}"
        out.append(" ".join(w))
    return out


def test_near_awkward(make, awkward):
    assert near_found(banded_jaccard.near_duplicates(make(awkward))) == near(awkward)


@pytest.mark.parametrize("block", [512, 7])
def test_near_groups_in_blocks(make, block):
    texts = variants(40, 3, 1) + variants(3, 2, 2) + variants(1, 0, 3) * 25 + [f"clean text number {i} with words of its own {i * 7}" for i in range(20)]
    given = list(enumerate(texts))
    assert near_found(banded_jaccard.near_duplicates(make(given).repartition(8), block=block)) == near(given)


def test_one_of_each_class_stays(make):
    given = list(enumerate(variants(12, 2, 5) + ["alone in the world of five words"])) + [(None, "no id")]
    docs = make(given)
    kept = banded_jaccard.one_of_each(docs)
    classes = {r[1] for r in near(given)}
    assert kept.columns == docs.columns
    assert {str(r.doc_id) for r in kept.collect()} == classes
    assert banded_jaccard.one_of_each(make([])).count() == 0


def test_bands_reach_the_recall():
    for t, recall, hashes in ((0.8, 0.9995, 160), (0.8, 0.99, 64), (0.5, 0.95, 128)):
        b, r = banded_jaccard.choose_bands(t, recall, hashes)
        assert b * r <= hashes and 1 - (1 - t ** r) ** b >= recall
    with pytest.raises(ValueError):
        banded_jaccard.choose_bands(0.1, 0.9999, 8)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
