"""Token ids of whole texts, encoding each distinct piece between blanks once per worker."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

#: Marks that may stand after a word without a bearing on its ids, nor the word on theirs.
_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{}~"
# The bytes that byte-level vocabularies write as themselves; the others, in order, are written from U+0100 on.
_AS_THEMSELVES = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
_AS_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _AS_THEMSELVES)}
#: Holds new pieces apart when they are encoded in one call.
_APART = "|"
#: Distinct pieces that a worker remembers; beyond that it starts anew.
MOST_WORDS = 400_000
_HELD: dict[str, WordEncoder] = {}


def _is_plain_word(word: str) -> bool:
    """Lower-case Latin letters only, up to U+024F: no normal form changes them."""
    return word.isalpha() and word.islower() and (word.isascii() or max(word) < "\u0250")


class Numbered(dict):
    """Numbers new words as they are asked for."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordEncoder:
    """Encodes with a `tokenizers` file.

    If the tokenizer drops white space, the ids of a text are those of its pieces
    between blanks and line breaks, one after the other. New pieces are encoded in one
    call, held apart by a mark with an id of its own; pieces with that mark, or with what may be
    a special token, are encoded alone. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        ids = self._ids(["a b\n\nc | d", "a", "b", "c", "d", _APART])
        self.apart = ids[5][0]
        self.by_word = len(ids[5]) == 1 and ids[0] == ids[1] + ids[2] + ids[3] + ids[5] + ids[4]
        # Words of plain letters, and marks after them, are tokens of their own for this tokenizer.
        probe = ["été", _MARKS, "straße", "word", "...", "ñandú", "a", ","]
        ids = self._ids([f"{probe[0]}{_MARKS} straße", "word...", "ñandú a,", *probe])
        self.by_mark = self.by_word and all(self._word(w) == x for w, x in zip(probe, ids[3:]) if _is_plain_word(w))
        self.by_mark = self.by_mark and ids[:3] == [sum(ids[3:6], []), sum(ids[6:8], []), sum(ids[8:], [])]
        # Fewer distinct pieces, where case makes no difference.
        ids = self._ids(["Ab É ab é", "ab é ab é"])
        self.any_case = ids[0] == ids[1]
        self._clear()

    def _clear(self) -> None:
        self.words, self.starts, self.counts, self.pool, self.used = Numbered(), np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, self.dtype), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> list[int]:
        """The ids of one word of plain letters, from the merges alone."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_AS_LETTERS)
        return [t.id for t in self.merges.tokenize(letters)]

    def _learn(self) -> None:
        """Find the ids of new pieces.

        Words of plain letters go to the merges directly, and those with marks after them have the ids of both; the others
        are encoded in a few texts, or alone.
        """
        joined, words, others = [], [], []
        for piece in self.words.new:  # grows by the words and marks found in it
            word = piece.rstrip(_MARKS) if self.by_mark else piece
            if not _is_plain_word(word):
                others.append(piece)
            elif len(word) < len(piece):
                joined.append((self.words[piece], self.words[word], self.words[piece[len(word) :]]))
            else:
                words.append(piece)
        self.words.new = []
        if not self.by_mark:
            words, others = [], words + others
        alone = [w for w in others if _APART in w or "<" in w]
        together = [w for w in others if not (_APART in w or "<" in w)]
        lists = [self._word(w) for w in words] + self._ids(alone)
        for i in range(0, len(together), 2000):
            ids = np.array(self._ids([" | ".join(together[i : i + 2000]) + " |"])[0], self.dtype)
            ends = np.flatnonzero(ids == self.apart)
            lists += [x[:-1] for x in np.split(ids, ends[:-1] + 1)]
        number = np.array([self.words[w] for w in (*words, *alone, *together)], np.int64)
        self.starts, self.counts = (_room(x, len(self.words)) for x in (self.starts, self.counts))
        self._put(number, np.fromiter(map(len, lists), np.int64, len(lists)), np.concatenate([np.zeros(0, self.dtype), *[np.asarray(x, self.dtype) for x in lists[len(words) :]]]), lists[: len(words)])
        if joined:
            pieces, halves = np.array(joined, np.int64)[:, 0], np.array(joined, np.int64)[:, 1:].ravel()
            sizes = self.counts[halves]
            flat = self.pool[np.repeat(self.starts[halves] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
            self._put(pieces, sizes.reshape(-1, 2).sum(1), flat)

    def _put(self, number: np.ndarray, counts: np.ndarray, flat: np.ndarray, before: list[list[int]] = ()) -> None:
        """Remember the ids of numbered pieces: those of the lists in `before`, then `flat`."""
        total = int(counts.sum())
        self.pool = _room(self.pool, self.used + total)
        first = total - len(flat)
        self.pool[self.used : self.used + first] = np.fromiter((i for x in before for i in x), self.dtype, first)
        self.pool[self.used + first : self.used + total] = flat
        self.starts[number], self.counts[number] = self.used + np.cumsum(counts) - counts, counts
        self.used += total

    def _plain(self, text: str) -> str:
        """The text in a form that has the same ids."""
        # Special tokens are met in the raw text; Σ is the one letter whose lower case depends on its place.
        if self.any_case and "<" not in text and "Σ" not in text:
            text = text.lower()
        return text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(ids, self.dtype) for ids in self._ids(texts)]
        if len(self.words) > MOST_WORDS:
            self._clear()
        number = self.words.__getitem__
        split = [self._plain(t).replace("\n", " ").split(" ") for t in texts]
        at = np.fromiter(map(number, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        if self.words.new:
            self._learn()
        counts = self.counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.pool[np.repeat(self.starts[at] - (ends - counts), counts) + np.arange(total)]
        cuts = np.concatenate(([0], ends))[np.cumsum([len(w) for w in split])]
        return np.split(flat, cuts[:-1])


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """`array` with room for `size` elements."""
    return array if len(array) >= size else np.concatenate((array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)))


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _HELD:
        _HELD[path] = WordEncoder(path)
    return _HELD[path]


def text_slices(column, most: int = 500_000):
    """Ranges of rows of an Arrow text column with about `most` bytes each."""
    sizes = np.asarray(column.to_numpy(zero_copy_only=False))
    start = 0
    while start < len(sizes):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), most)))
        yield start, stop
        start = stop
