"""Token ids of whole texts by a public tokenizer, with each distinct word encoded once per worker.

A byte-level BPE splits a text into pieces before it merges, and a piece never crosses from a
non-space character into white space.  A text therefore has the ids of its words, one after the
other, where a word is taken with all the white space before it.  Words are cut before runs that
begin with a space or a line feed; any other white space stays inside its word.  Words repeat, so
their ids are kept in a bounded table, which Arrow looks them up in.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE = "byte_bpe_50k.json"

# Bounds of the word table; they limit memory only, a word outside it is encoded again.
WORDS_KEPT = 1_000_000
WORD_CHARS = 48
WORDS_AT_ONCE = 5_000
CHARS_AT_ONCE = 8 << 20

_ADJACENT_SPACE = re.compile(r"\s\s")
_BEFORE_SPACE = re.compile(r"(?<!\s)(?=[ \n])")
# letters of Latin scripts, which a byte-level pre-tokeniser parts from ASCII marks at the end of a word
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_LETTERS = "^[ \n]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+$"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _runs(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``begin``, one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Words:
    """Different words, their ids one after the other, and which were met again."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.flat, self.size, self.again = np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)

    def add(self, words: pa.Array, flat: np.ndarray, size: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        self.again = np.concatenate([self.again, np.zeros(len(size), dtype=bool)])

    def places(self, words: pa.Array) -> np.ndarray:
        """Where the words stand, -1 for those that are not here."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.array(pc.fill_null(pc.index_in(words, value_set=self.words), -1), dtype=np.int64)
        self.again[at[at >= 0]] = True
        return at

    def shrink(self, most: int) -> None:
        """Leave the words met again, or none where these are more than ``most``."""
        kept, now = self.again, Words()
        if np.count_nonzero(kept) <= most:
            now.add(self.words.filter(pa.array(kept)), self.flat[np.repeat(kept, self.size)], self.size[kept])
        self.__dict__ = now.__dict__


class WordEncoder:
    """Encodes texts to the ids of the tokenizers library, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.words_kept = words_kept
        self.known = Words()
        pieces = self.tokenizer.get_vocab()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        # a piece has one character for each of its bytes; a special token is its own text
        self._bytes_of = np.zeros(max(pieces.values()) + 1, dtype=np.int64)
        for piece, i in pieces.items():
            self._bytes_of[i] = len(piece.encode()) if piece in special else len(piece)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and how many each has."""
        ids = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, dtype="<u4"), *ids]), np.array([len(i) for i in ids], dtype=np.int64)

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that start with white space and end without: one text, cut again by byte counts."""
        texts, size = words.to_pylist(), pc.binary_length(words).to_numpy()
        flat, counts = [np.empty(0, dtype="<u4")], [np.empty(0, dtype=np.int64)]
        for at in range(0, len(texts), WORDS_AT_ONCE):
            text = "".join(texts[at:at + WORDS_AT_ONCE])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            reached, ends = np.cumsum(self._bytes_of[ids]), np.cumsum(size[at:at + WORDS_AT_ONCE])
            cut = np.searchsorted(reached, ends) + 1
            if cut[-1] != len(ids) or not np.array_equal(reached[cut - 1], ends):
                return self._each(texts)  # a piece crosses two words: never seen, but then the words go one by one
            flat.append(ids)
            counts.append(np.diff(cut, prepend=0))
        return np.concatenate(flat), np.concatenate(counts)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words by the library; all but long words are put into the table."""
        odd = np.array([w[:1] not in (" ", "\n") or w[-1].isspace() for w in words.to_pylist()], dtype=bool)
        flat, size = self._joined(words.filter(pa.array(~odd)))
        if odd.any():
            more, n = self._each(words.filter(pa.array(odd)).to_pylist())
            place = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
            flat, size = np.concatenate([flat, more]), np.concatenate([size, n])
            begin = np.cumsum(size) - size
            flat, size = _runs(flat, begin[place], size[place]), size[place]
        short = pc.utf8_length(words).to_numpy() <= WORD_CHARS
        self.known.add(words.filter(pa.array(short)), flat[np.repeat(short, size)], size[short])
        return flat, size

    def _whole(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array with the ids of different words: where each word's begin, and how many it has."""
        at, flat, size = self.known.places(words), self.known.flat, self.known.size
        new = at < 0
        if new.any():
            more, n = self._learn(words.filter(pa.array(new)))
            at[new] = len(size) + np.arange(len(n))
            flat, size = np.concatenate([flat, more]), np.concatenate([size, n])
        return flat, (np.cumsum(size) - size)[at], size[at]

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_whole``, with words of letters and marks after them put together from both: marks are few and letters repeat."""
        letters = pc.utf8_rtrim(words, characters=MARKS)
        marked = pc.and_(pc.less(pc.binary_length(letters), pc.binary_length(words)), pc.match_substring_regex(letters, _LETTERS))
        marks = [w[len(t):] for w, t in zip(words.filter(marked).to_pylist(), letters.filter(marked).to_pylist())]
        parts = pa.concat_arrays([pc.if_else(marked, letters, words), pa.array(marks, pa.large_string())]).dictionary_encode()
        flat, begin, size = self._whole(parts.dictionary)
        at, mine = parts.indices.to_numpy(), marked.to_numpy(zero_copy_only=False)
        at, last = at[:len(words)], at[len(words):]
        both = np.stack([at[mine], last], axis=1)
        begin_of, size_of, n = begin[at], size[at], size[both].sum(axis=1)
        begin_of[mine], size_of[mine] = len(flat) + np.cumsum(n) - n, n
        return np.concatenate([flat, _runs(flat, begin[both].ravel(), size[both].ravel())]), begin_of, size_of

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and how many each has."""
        if len(self.known.words) > self.words_kept:
            self.known.shrink(self.words_kept // 2)
        cut, odd = [], []
        for at, text in enumerate(texts):
            if "\0" in text:
                odd.append(at)
                text = ""
            elif _ADJACENT_SPACE.search(text):
                text = "\0".join([w for w in _BEFORE_SPACE.split(text) if w])
            else:  # the same cuts, made faster
                text = text.replace(" ", "\0 ").replace("\n", "\0\n")
            cut.append(text)
        parts = pc.split_pattern(pa.array(cut, pa.large_string()), "\0")
        words = parts.flatten().dictionary_encode()
        flat, begin, size = self._ids_of(words.dictionary)
        place = words.indices.to_numpy()
        n = size[place]
        out, stops = _runs(flat, begin[place], n), np.concatenate([[0], np.cumsum(n)])[parts.offsets.to_numpy()]
        if not odd:
            return out, np.diff(stops)
        found = [out[a:b] for a, b in zip(stops[:-1], stops[1:])]
        whole, n = self._each([texts[at] for at in odd])
        for at, own in zip(odd, np.split(whole, np.cumsum(n)[:-1])):
            found[at] = own
        return np.concatenate(found), np.array([len(x) for x in found], dtype=np.int64)

    def encode_flat(self, texts: list[str], end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of the texts, one after the other and each followed by ``end_id``, and where each text's end, some texts at a time."""
        at, held = 0, 0
        for end, text in enumerate(texts, 1):
            held += len(text)
            if held >= CHARS_AT_ONCE or end == len(texts):
                ids, n = self._encode(texts[at:end])
                ends = np.cumsum(n)
                if end_id is not None:
                    ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                yield ids, ends
                at, held = end, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in order."""
        out = []
        for ids, ends in self.encode_flat(texts):
            data, stops = ids.tobytes(), (ends * 4).tolist()
            out += [data[a:b] for a, b in zip([0, *stops], stops)]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and tokenizer file."""
    return WordEncoder(path)
