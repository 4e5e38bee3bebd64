"""Exact SentencePiece segmentation from a table of distinct marked words.

If no piece of the vocabulary holds a whitespace marker after another
character, no merge can cross from a word into the marker that follows it. The
segmentation of a text is then the concatenation of the segmentations of its
marked words (a run of markers and the characters up to the next marker), and
each distinct one needs to be segmented only once.
"""

from __future__ import annotations

import re

import numpy as np

MARK = "▁"
_WORD = re.compile(" +[^ ]*")
_loaded: dict[str, object] = {}


def load(model: str):
    """The processor of a model file, one for each Python process."""
    if model not in _loaded:
        import sentencepiece

        _loaded[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _loaded[model]


def words_are_separate(sp) -> bool:
    """Do markers only lead pieces, with the text otherwise left as it is?"""
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_byte(i) and not sp.is_unknown(i))
    same = all(sp.decode(sp.encode(t)) == t for t in ("a  b", " a ", "é é ﬁ", "a\tb\n"))
    return same and not any(MARK in p.lstrip(MARK) for p in pieces)


def marked_words(text: str) -> list[str]:
    """Marked words of ``text``, each without its first marker; the marker in
    front of the text that the library adds is implied."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " not in text and text[0] != " ":
        return text.split(" ")
    return [w[1:] for w in _WORD.findall(" " + text)]


class WordTable:
    """Ids of distinct marked words, for a process; emptied when it holds
    ``limit`` words, so memory is bounded and results don't change."""

    def __init__(self, sp, limit: int = 300_000):
        self.sp, self.limit = sp, limit
        self.alone = [sp.piece_to_id(MARK)]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids: list[list[int]] = []
        self.counts = np.zeros(0, np.int64)
        self.offsets = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def add(self, texts: list[list[str]]) -> None:
        """Segment the words of ``texts`` that the table doesn't hold yet."""
        new = set().union(*texts).difference(self.at)
        if len(self.at) + len(new) > self.limit and self.at:
            self.clear()
            new = set().union(*texts)
        if not new:
            return
        words = list(new)
        ids = self.sp.encode(words, num_threads=1)
        ids = [i if w else self.alone for i, w in zip(ids, words)]
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.offsets = np.concatenate((self.offsets, len(self.flat) + np.cumsum(n) - n))
        self.counts = np.concatenate((self.counts, n))
        self.flat = np.concatenate((self.flat, np.fromiter((x for i in ids for x in i), np.int32, int(n.sum()))))

    def codes(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def gather(self, codes: np.ndarray) -> np.ndarray:
        """Ids of the words with these codes, joined by position."""
        n = self.counts[codes]
        start = np.repeat(self.offsets[codes] - (np.cumsum(n) - n), n)
        return self.flat[start + np.arange(len(start))]


_separate: dict[str, bool] = {}
_tables: dict[str, WordTable] = {}


def separate(model: str) -> bool:
    """words_are_separate() of a model, checked once for a process."""
    if model not in _separate:
        _separate[model] = words_are_separate(load(model))
    return _separate[model]


def word_table(model: str) -> WordTable | None:
    """The process's table of a model, or None if its pieces cross markers."""
    if model not in _tables and separate(model):
        _tables[model] = WordTable(load(model))
    return _tables.get(model)


def text_runs(texts: list[str], limit: int = 1 << 20):
    """Slices of ``texts`` of about ``limit`` characters."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)
