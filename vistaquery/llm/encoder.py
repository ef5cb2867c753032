"""Byte-level BPE ids of whole texts, by the tokenizers library.

A single space or line feed between two characters that are no white space always ends a
piece of this tokenizer's splitting.  So a text is cut there, and each distinct chunk (a space
and a word, or a line feed and a word) is encoded once and remembered.  A text with any other
white space next to such a place is cut only where both neighbours are no white space."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .work import REMEMBERED

#: Distinct chunks that a worker remembers; beyond it those seen least are forgotten.
REMEMBER = 600_000
#: New chunks that are encoded as one text.
JOINED = 2_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Known(dict):
    """Chunk -> row; a chunk that is not there gets the next row and is listed as new."""

    def __init__(self, *a) -> None:
        super().__init__(*a)
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        row = self[chunk] = len(self)
        self.new.append(chunk)
        return row


def _odd(word: str) -> bool:
    """Whether a chunk that was cut at plain spaces and line feeds may belong to its neighbours."""
    bare = word[1:] if word[:1] == "\n" else word
    return not bare or bare[0].isspace() or bare[-1].isspace()


class ChunkEncoder:
    """encode(texts) -> flat ids and the count of each text."""

    def __init__(self, path: str, remember: int = REMEMBER) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.remember = remember
        self.size = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():  # a character stands for a byte, but in added tokens
            self.size[i] = len(token)
        for i, added in self.tokenizer.get_added_tokens_decoder().items():
            self.size[i] = len(added.content.encode())
        self.forget_all()

    def forget_all(self) -> None:
        self.known = _Known()
        self.ids, self.at, self.used = np.zeros(1 << 16, dtype=np.int32), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that begin with a space or a line feed, and how many each has.  Many are
        encoded as one text, as they stay apart there; the bytes of the ids tell where each ends."""
        texts = ["".join(chunks[i : i + JOINED]) for i in range(0, len(chunks), JOINED)]
        flat = np.concatenate([np.array(x.ids, dtype=np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        size = pc.binary_length(pa.array(chunks, pa.large_string())).to_numpy()
        return flat, np.diff(np.searchsorted(np.cumsum(self.size[flat]), np.cumsum(size)) + 1, prepend=0)

    def _learn(self, words: list[str]) -> None:
        """Punctuation behind a word of plain letters is a piece of its own: both are encoded once,
        and a word that is known without it is not encoded again."""
        parts: dict[str, int] = {}
        first, second = np.empty(len(words), dtype=np.int64), np.full(len(words), -1, dtype=np.int64)
        odd, learned, rows = np.zeros(len(words), dtype=bool), len(self.used), []
        for k, word in enumerate(words):
            if not word.isalpha():
                bare = word.rstrip(_TAIL)
                if len(bare) < len(word) and bare.isalpha() and max(bare) < "\u0250":
                    second[k] = parts.setdefault("\n" + word[len(bare) :], len(parts))
                    row = self.known.get(bare, learned)
                    if row < learned:
                        rows.append(row)
                        first[k] = -len(rows)
                        continue
                    word = bare
                elif _odd(word):
                    odd[k] = True
                    word = "?"  # its row is never used
            first[k] = parts.setdefault(word if word[0] == "\n" else " " + word, len(parts))
        flat, counts = self._each(list(parts))
        if rows:  # those known go behind the new parts
            first = np.where(first < 0, len(counts) - 1 - first, first)
            more = np.diff(self.at)[rows]
            flat, counts = np.concatenate([flat, gather(self.ids, self.at[rows], more)]), np.concatenate([counts, more])
        at = np.cumsum(counts) - counts
        feed = len(self._each(["\n?"])[0]) - 1  # ids of the line feed before the punctuation
        skip = np.where(second < 0, 0, feed)
        start = np.stack([at[first], np.where(second < 0, 0, at[second] + skip)], 1).ravel()
        many = np.stack([counts[first], np.where(second < 0, 0, counts[second] - skip)], 1)
        end = self.at[-1] + np.cumsum(many.sum(1))
        if end[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(int(end[-1]), dtype=np.int32)])
        self.ids[self.at[-1] : end[-1]] = gather(flat, start, many.ravel())
        self.at = np.concatenate([self.at, end])
        self.used = np.concatenate([self.used, np.where(odd, -(1 << 40), 0)])

    def _forget(self) -> None:
        often = (self.used > 1) | (self.used < 0)
        if often.sum() > self.remember // 2:
            often &= (self.used > np.median(self.used[often])) | (self.used < 0)
        words = [k for k, keep in zip(self.known, often) if keep]
        rows = np.flatnonzero(often)
        counts = np.diff(self.at)[rows]
        self.ids = np.concatenate([gather(self.ids, self.at[rows], counts), np.zeros(1 << 16, dtype=np.int32)])
        self.at = np.concatenate([[0], np.cumsum(counts)])
        self.known = _Known(zip(words, range(len(words))))
        self.used = np.where(self.used[rows] < 0, -(1 << 40), 0)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.remember:
            self._forget()
        words: list[str] = []
        size = np.zeros(len(texts), dtype=np.int64)
        heads: list[str] = []
        for i, text in enumerate(texts):
            if text:
                own = (text.replace("\n", " \n") if "\n" in text else text).split(" ")
                heads.append(own[0])
                own[0] = "\n"  # an odd one
                size[i] = len(own)
                words += own
        row = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        last = np.concatenate([[0], np.cumsum(size)])
        filled = np.flatnonzero(size)
        odd = self.used[row] < 0
        odd[last[filled]] = False
        plain = np.diff(np.concatenate([[0], np.cumsum(odd)])[last]) == 0
        plain[filled[[not h or h[-1].isspace() or _odd(h) for h in heads]]] = False
        counts = np.diff(self.at)[row]
        counts[last[filled]] = 0
        self.used += np.bincount(row[~odd], minlength=len(self.used)) * (self.used >= 0)
        out, n = [], np.diff(np.concatenate([[0], np.cumsum(counts)])[last])
        begin, at, head = self.at[row], 0, dict(zip(filled.tolist(), heads))
        first = self.tokenizer.encode_batch_fast([head[i] if plain[i] else "" for i in filled.tolist()], add_special_tokens=False)
        slow = {}
        for i in np.flatnonzero(~plain).tolist():
            slow[i] = self._text(texts[i])
        flat = gather(self.ids, begin, counts)
        ends = np.cumsum(n)
        for i, x in zip(filled.tolist(), first):
            ids = slow.get(i)
            if ids is None:
                ids = np.concatenate([np.array(x.ids, dtype=np.int32), flat[ends[i] - n[i] : ends[i]]])
            out.append(ids)
            n[i] = len(ids)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32), np.where(size > 0, n, 0)

    def _text(self, text: str) -> np.ndarray:
        """A text with odd white space, cut where it is safe."""
        own = _CUT.split(text)
        head = np.array(self.tokenizer.encode(own[0], add_special_tokens=False).ids, dtype=np.int32)
        return np.concatenate([head, self._each([" " + x for x in own[1:]])[0]]) if len(own) > 1 else head


def gather(values: np.ndarray, start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + counts[i]] of all i, one after the other."""
    total = int(counts.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(counts)
    return values[np.arange(total) + np.repeat(start - (ends - counts), counts)]


_ENCODERS: dict[str, ChunkEncoder] = {}
REMEMBERED.append(lambda: [x.forget_all() for x in _ENCODERS.values()])


def encoder(path: str, remember: int = REMEMBER) -> ChunkEncoder:
    """The worker's own encoder for that file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    _ENCODERS[path].remember = remember
    return _ENCODERS[path]
