"""Token counts, token files and packing against the tokenizers library itself."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gameline.llm import arrow_ids, common, packing, token_cache
from gameline.llm.encoding import WordEncoder, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encode(tokenizer):
    return lambda texts: [e.ids for e in tokenizer.encode_batch(["" if t is None else t for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z9'.,!\n\t\r 　éß漢<|>\0\x1c\x85"), max_size=30), max_size=6))
def test_word_encoder_equals_library(texts):
    e = test_word_encoder_equals_library.encoder
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in e.encode(texts)] == [
        x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


test_word_encoder_equals_library.encoder = WordEncoder(tokenizer_path(), words_kept=50)


def test_word_encoder_on_special_strings(encode):
    texts = ["x<|endoftext|>y <|endoftext|> z\n<|endoftext|>", "don't 's 'll we've", "a" * 300 + " b", " lead", "trail ", "\n"]
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in WordEncoder(tokenizer_path()).encode(texts)]
    assert got == encode(texts)


def test_counts_of_awkward_rows(spark, make, awkward, encode, rows):
    cache = common.new_folder(spark, "cache")
    got = rows(token_cache.token_counts(make(awkward), cache))
    want = sorted((i is None, i or 0, len((t or "").encode()), len(x)) for (i, t), x in zip(awkward, encode([t for _, t in awkward])))
    assert sorted((i != i or i is None, 0 if i != i or i is None else int(i), b, n)
                  for i, b, n in zip(got.doc_id, got.n_bytes, got.n_tokens)) == want


def test_cache_encodes_only_what_is_missing(spark, make, rows, monkeypatch):
    cache = common.new_folder(spark, "cache")
    token_cache.token_counts(make([(1, "one text"), (2, "one text"), (3, "two")]), cache)
    stored = spark.read.parquet(cache)
    assert stored.count() == 2
    got = rows(token_cache.token_counts(make([(1, "one text"), (4, "three"), (5, "three")]), cache))
    assert len(got) == 3 and spark.read.parquet(cache).count() == 3
    # another tokenizer has counts of its own
    token_cache.token_counts(make([(1, "one text")]), cache, tokenizer_path("word_bpe_49k.json"))
    assert spark.read.parquet(cache).select("tokenizer_digest").distinct().count() == 2


def test_empty_tables(spark, make, rows):
    none = make([])
    assert token_cache.token_counts(none, common.new_folder(spark, "cache")).count() == 0
    assert arrow_ids.read_documents(arrow_ids.write_sequences(none)).count() == 0
    assert packing.pack(none).count() == 0


def test_op6_whole_table(spark, data, documents, encode, rows):
    got = rows(token_cache.op6(spark, data)).sort_values("doc_id")
    n = [len(x) for x in encode(documents.text)]
    assert got.n_tokens.tolist() == n
    assert got.n_bytes.tolist() == [len(t.encode()) for t in documents.text]
    assert got.over_limit.tolist() == [x > 512 for x in n]


def test_op7_whole_table(spark, data, documents, encode, rows):
    got = rows(arrow_ids.op7(spark, data)).sort_values("doc_id")
    ids = [x + [2] for x in encode(documents.text)]
    n = np.array([len(x) for x in ids])
    assert got.n_tokens.tolist() == n.tolist()
    assert got.start.tolist() == (np.cumsum(n) - n).tolist()
    assert got.ids_crc32.tolist() == [crc(x) for x in ids]


def test_sequences_are_equal_and_masked(spark, make, awkward, encode, rows):
    manifest = arrow_ids.write_sequences(make(awkward), length=16)
    ids = []
    for path, n in sorted((r.path, r.n_ids) for r in manifest.collect()):
        file = arrow_ids.SequenceFile(path)
        last = -(-n // 16) - 1
        for i in range(last + 1):
            seq, mask = file[i]
            assert len(seq) == len(mask) == 16 and not seq.flags.owndata  # a view of the file
            assert mask.true_count == (16 if i < last else n - 16 * last)
            ids += seq[:mask.true_count].tolist()
    ordered = sorted(awkward, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert ids == [x for t in encode([t for _, t in ordered]) for x in t + [2]]
    back = rows(arrow_ids.read_documents(manifest)).sort_values("start", kind="stable")
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in back.ids] == [x + [2] for x in encode([t for _, t in ordered])]


def brute_windows(points, penalties, length):
    best = {0: (0.0, [])}
    for j in range(1, len(points)):
        options = []
        for i in range(j):
            size = points[j] - points[i]
            if size <= length and i in best:
                pad = 0 if size & (size - 1) == 0 else length - size
                options.append(best[i][0] + pad + penalties[j])
        best[j] = (min(options), None)
    return best[len(points) - 1][0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0.0, 2.0, 9.0])), min_size=1, max_size=14))
def test_windows_cost_the_least(steps):
    points = np.concatenate([[0], np.cumsum([s for s, _ in steps])])
    penalties = np.array([0.0] + [p for _, p in steps])
    ends = packing.cut_windows(points, penalties, 16)
    assert ends[-1] == points[-1] and set(ends) <= set(points.tolist())
    sizes = np.diff([0, *ends])
    assert sizes.max() <= 16
    pay = dict(zip(points.tolist(), penalties))
    cost = sum(pay[e] for e in ends) + sum(0 if s & (s - 1) == 0 else 16 - s for s in sizes.tolist())
    assert cost == brute_windows(points.tolist(), penalties, 16)


def check_pieces(got, docs, ids_of, length=2048):
    """Each id in one piece, sequences gapless and in order."""
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == (np.cumsum(seq.length) - seq.length).tolist()
        assert seq.length.sum() <= length
    for _, own in got.groupby("doc_id"):
        own = own.sort_values("start")
        ids = ids_of[own.doc_id.iloc[0]]
        assert own.start.tolist() == (np.cumsum(own.length) - own.length).tolist()
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        assert own.ids_crc32.tolist() == [crc(ids[s:s + n]) for s, n in zip(own.start, own.length)]
    assert set(got.doc_id) == set(docs)


def test_op9_whole_table(spark, data, documents, encode, rows):
    got = rows(packing.op9(spark, data))
    check_pieces(got, documents.doc_id, dict(zip(documents.doc_id, [x + [1] for x in encode(documents.text)])))
    n = got.groupby("sequence_id").length.sum()
    pad = sum(0 if x & (x - 1) == 0 else 2048 - x for x in n.tolist())
    assert pad < 0.02 * n.sum()


def test_packing_of_awkward_rows(spark, make, encode, rows):
    given_rows = [(1, "one."), (2, None), (3, ""), (4, "Long words follow each other. " * 3000), (5, "x" * 40000), (6, "a b")]
    got = rows(packing.digested(packing.pack(make(given_rows), order_by="doc_id")))
    check_pieces(got, [r[0] for r in given_rows], dict(zip([r[0] for r in given_rows], [x + [1] for x in encode([t for _, t in given_rows])])))
    repeated = rows(packing.pack(make([(1, "a b"), (1, "a b"), (None, "c")])))
    assert len(repeated) == 3


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.characters = tokenizer, 0

    def encode_batch_fast(self, texts, **settings):
        self.characters += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **settings)


def test_letters_are_encoded_once_whatever_marks_follow():
    encode = WordEncoder(tokenizer_path())
    encode.tokenizer = Counting(encode.tokenizer)
    marks = [",", ".", "!!", "%%%", ".***", "'", '")', "-"]
    text = "".join(f" {w}{m}" for m in marks for w in ("untwistedness", "überläufe", "hors"))
    assert np.frombuffer(encode.encode([text])[0], dtype="<u4").tolist() == encode.tokenizer.tokenizer.encode(
        text, add_special_tokens=False).ids
    assert encode.tokenizer.characters < len(text) / 2


def test_words_with_marks_equal_the_library():
    words = ["don't", "it's,", "'s", "x's.", "é,'", "l'eau,", "naïve'll", "a'", "'", "ªº.", "ǅ!", "ǰ,'s", "日本,", "é.", "<|endoftext|>.", "½.", "a1,", "_a_", "ⅷ,", "ʼn,", "ˮ,"]
    texts = [f"{before}{w}{after}" for w in words for before in ("", " ", "\n", "\t", "x ", " \n") for after in ("", " ", "\n", "s ", " 's", "\0")]
    encode = WordEncoder(tokenizer_path(), words_kept=20)
    for some in (texts, texts[::-1], texts[:7]):
        got = [np.frombuffer(x, dtype="<u4").tolist() for x in encode.encode(some)]
        assert got == [e.ids for e in encode.tokenizer.encode_batch(some, add_special_tokens=False)]


def test_flat_ids_end_with_the_end_id(monkeypatch):
    monkeypatch.setattr("gameline.llm.encoding.CHARS_AT_ONCE", 12)
    texts = ["", "one two", "", "", "three, four.\n\nfive \0 six", ""]
    encode, own = WordEncoder(tokenizer_path()), []
    for ids, ends in encode.encode_flat(texts, 2):
        own += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert own == [[*e.ids, 2] for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
