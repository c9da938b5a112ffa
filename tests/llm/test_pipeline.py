"""The pipeline against brute force on a small fixture, stage by stage and as a whole."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gameline.llm import banded_jaccard, common, factor_machine, mixing
from test_duplicates import exact, near, variants
from tokenizers import Tokenizer

from gameline.llm.encoding import tokenizer_path


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels: junk, copies, near copies, a large and a small source."""
    rng = np.random.default_rng(3)
    words = "the river runs under an old bridge while people walk along its quiet banks in evening light".split()

    def prose(n):
        return " ".join(rng.choice(words, n)) + "."

    texts = [prose(int(rng.integers(30, 90))) for _ in range(220)]
    texts += ["SHOUT!! " * int(rng.integers(20, 60)) for _ in range(60)]  # junk
    texts += [texts[i % 7] for i in range(20)] + variants(12, 3, 9) + [None, ""]
    source = ["big" if i % 4 else "small" for i in range(len(texts))]
    docs = pd.DataFrame({"doc_id": np.arange(len(texts)), "text": texts, "lang": "en", "source": source,
                         "n_chars": [len(t or "") for t in texts]})
    labels = pd.DataFrame({"doc_id": np.arange(280), "quality": [int(i < 220) for i in range(280)], "toxic": 0})
    folder = tmp_path_factory.mktemp("corpus")
    docs.to_parquet(folder / "documents.parquet")
    labels.to_parquet(folder / "labels.parquet")
    return str(folder), docs


def keyed(df):
    return sorted((r.doc_id, r.text or "") for r in df.collect())


def test_stages_one_by_one(spark, corpus, rows):
    folder, pdf = corpus
    docs = common.table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]
    good = common.stored(stages["quality"](spark, docs, folder), "t")
    machine = factor_machine.train(docs, common.table(spark, folder, "labels"))
    want = [(i, t or "") for i, t, n in zip(pdf.doc_id, pdf.text, pdf.n_chars)
            if 1 / (1 + np.exp(-machine.logit(*factor_machine.inputs(t or "", n)))) >= 0.3]
    assert keyed(good) == sorted(want) and good.columns == docs.columns
    assert {i for i, _ in want} >= set(range(220)) and not {i for i, _ in want} & set(range(220, 280))

    single = common.stored(stages["exact_dedup"](spark, good, folder), "t")
    stays = {(int(i)) for i, _, _, kept in exact(want) if kept}
    assert keyed(single) == sorted((i, t) for i, t in want if i in stays)

    apart = common.stored(stages["near_dedup"](spark, single, folder), "t")
    given = keyed(single)
    classes = {r[1] for r in near(given)}
    assert keyed(apart) == sorted((i, t) for i, t in given if str(i) in classes)

    mix = common.stored(stages["mix"](spark, apart, folder), "t")
    drawn = rows(mixing.draw(mixing.sizes(apart)))
    assert mix.columns == docs.columns
    assert sorted(r.doc_id for r in mix.collect()) == sorted(drawn.id)
    for p in mixing.plan_weights(mixing.sizes(apart)).collect():
        own = drawn[drawn.source == p.source].tokens
        assert p.budget <= own.sum() < p.budget + own.max()

    pieces = rows(stages["pack"](spark, mix, folder))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    sizes = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in keyed(mix)}
    assert pieces.length.sum() == sum(sizes[i] for i in drawn.id)


def test_run_is_the_stages(spark, corpus, rows):
    folder, _ = corpus
    got = rows(entry.queries()["pipeline"](spark, folder))
    docs = common.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, folder), name)
    want = rows(corpus_pipeline.STAGES[-1][1](spark, docs, folder))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))
    once = got.groupby("doc_id").filter(lambda g: g.length.sum() == g.doc_tokens.iloc[0])
    assert len(once)


def test_empty_corpus(spark, tmp_path, make):
    make([], extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    found = sorted(int(n[2:].split("_")[0]) for n in names if n[2:].split("_")[0].isdigit())
    assert found == list(range(1, 14)) and "pipeline" in entry.queries()


def test_near_stage_keeps_clean_documents(make):
    clean = [(i, " ".join(f"w{i}_{j}" for j in range(40))) for i in range(30)]
    assert banded_jaccard.one_of_each(make(clean)).count() == 30
