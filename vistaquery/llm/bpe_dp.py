"""BPE encoding by dynamic programming over prefixes, and decoding.

The vocabulary is compiled to an Aho-Corasick automaton, which gives every token that is a
suffix of each prefix of a word.  The encoding of a prefix ends in exactly one token: the one
whose start is the end of a prefix with last token u such that u and it are compatible, that
is, merging u and it side by side never joins their border.  So one token is stored for each
prefix, and back-pointers from the end give the exact ids in time linear in the word.

Compatibility needs no merging: a token's right edge goes through the symbols of its merge tree
from a base symbol to itself, each until the rank of the merge that takes it up; so does a left
edge; the border is joined if and only if two symbols that are there at the same time form a
merge that comes before either is taken up (at equal ranks the left merge goes first).

Texts are normalized and split as the tokenizer's file says: NFC, white space to one space,
lower case letter by letter, the split pattern, bytes as characters; the last character of a
word carries the end-of-word suffix.  Added tokens are found in the raw text first.  Decoding
joins the ids' tokens by one space, as for a file without a decoder.

Null text: empty, so no ids and an empty decoded text.  Words of any length; ties and repeated
rows do not matter.  Empty table: no rows.  Further columns stay; a column named ids is replaced.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .encoder import gather
from .work import REMEMBERED, give_back, part_tables

#: Chunks, and words, that a worker remembers; beyond it those seen least are forgotten.
REMEMBER = 200_000
#: Texts that are encoded at a time, in bytes.
STEP_BYTES = 2 << 20
_END = "\x00"
_NEVER = 1 << 60


def byte_characters() -> str:
    """The character that stands for each byte: printable ones for themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


class PrefixBPE:
    def __init__(self, path: str, remember: int = REMEMBER) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.pieces = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.as_characters = dict(enumerate(byte_characters()))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, (a, b) in enumerate(model["merges"]):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, k)
            self.parts.setdefault(whole, (*pair, k))
        self.edges: dict[tuple[int, bool], tuple[list[int], list[int]]] = {}
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            ended = bool(self.suffix) and text.endswith(self.suffix)
            bare = text[: len(text) - len(self.suffix)] if ended else text
            if bare and (len(bare) == 1 or i in self.parts and self._is_own_encoding(i)):
                self.automaton.add_word(bare + _END if ended else bare, (i, len(bare) + ended))
        self.automaton.make_automaton()
        self.words: dict[str, array] = {}
        self.remember = remember
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at, self.new = np.zeros(1 << 16, dtype=np.int32), np.zeros(1, dtype=np.int64), []
        self.used = np.zeros(0, dtype=np.int64)

    def _prune(self) -> None:
        """Keeps the chunks seen more than once, or of those the more frequent half."""
        often = self.used > 1
        if often.sum() > self.remember // 2:
            often &= self.used > np.median(self.used[often])
        names, rows, counts = [k for k, keep in zip(self.known, often) if keep], np.flatnonzero(often), np.diff(self.at)[often]
        flat = gather(self.ids, self.at[rows], counts)
        self._reset()
        self.ids, self.at = np.concatenate([flat, self.ids]), np.concatenate([[0], np.cumsum(counts)])
        self.known, self.used = dict(zip(names, range(len(names)))), np.zeros(len(names), dtype=np.int64)
        if len(self.words) >= self.remember:
            self.words.clear()
        if len(self.fits) > 2 * self.remember:
            self.fits.clear()

    def _edge(self, token: int, right: bool) -> tuple[list[int], list[int]]:
        """The symbols on that edge from the base symbol to the token, and when each is taken up."""
        got = self.edges.get((token, right))
        if got is None:
            symbols, until, x = [token], [_NEVER], token
            while x in self.parts:
                *pair, k = self.parts[x]
                x = pair[right]
                symbols.append(x)
                until.append(k)
            got = self.edges[token, right] = (symbols[::-1], until[::-1])
        return got

    def _border_stays(self, u: int, t: int, limit: int = _NEVER) -> bool:
        left, left_until = self._edge(u, True)
        right, right_until = self._edge(t, False)
        i = j = 0
        while True:
            k = self.rank.get((left[i], right[j]), _NEVER)
            if k < left_until[i] and k <= right_until[j] and k < limit:
                return False
            if left_until[i] == right_until[j] == _NEVER:
                return True
            if left_until[i] <= right_until[j]:
                i += 1
            else:
                j += 1

    def _is_own_encoding(self, token: int) -> bool:
        """Whether merging the token's text gives the token: its halves meet first at its own merge."""
        a, b, k = self.parts[token]
        return self._border_stays(a, b, k)

    def compatible(self, u: int, t: int) -> bool:
        key = u << 20 | t
        got = self.fits.get(key)
        if got is None:
            got = self.fits[key] = self._border_stays(u, t)
        return got

    def encode_word(self, word: str) -> array:
        """Of a word in byte characters."""
        n = len(word) + bool(self.suffix)
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        for end, (token, size) in self.automaton.iter(word + _END if self.suffix else word):
            start = end + 1 - size
            if last[end + 1] is None and (start == 0 or last[start] is not None and self.compatible(last[start][0], token)):
                last[end + 1] = (token, size)
        out, at = array("i"), n
        while at:
            if last[at] is None:
                raise ValueError("the vocabulary lacks a byte of this word")
            token, size = last[at]
            out.append(token)
            at -= size
        out.reverse()
        return out

    def _encode_chunk(self, chunk: str) -> array:
        if self.cut_added and "<" in chunk:
            parts = self.cut_added.split(chunk)
            if len(parts) > 1:
                out = array("i")
                for k, x in enumerate(parts):
                    if k % 2:
                        out.append(self.added[x])
                    elif x:
                        out += self._encode_chunk(x)
                return out
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
            chunk = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
        else:
            chunk = chunk.lower()
        out = array("i")
        for piece in self.pieces.findall(chunk):
            ids = self.words.get(piece)
            if ids is None:
                ids = self.encode_word(piece.encode().decode("latin-1").translate(self.as_characters))
                if len(self.words) < self.remember:
                    self.words[piece] = ids
            out += ids
        return out

    def _row(self, chunk: str) -> int:
        row = self.known[chunk] = len(self.known)
        self.new.append(chunk)
        return row

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if len(self.known) > self.remember:
            self._prune()
        chunks: list[str] = []
        size = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                own = regex.split(r"\s+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
                size[i] = len(own)
                chunks += own
        get, row = self.known.get, self._row
        rows = np.fromiter((k if (k := get(c)) is not None else row(c) for c in chunks), dtype=np.int64, count=len(chunks))
        if self.new:
            found = [self._encode_chunk(c) for c in self.new]
            end = self.at[-1] + np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            if end[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(int(end[-1]), dtype=np.int32)])
            self.ids[self.at[-1] : end[-1]] = np.frombuffer(b"".join(map(array.tobytes, found)), dtype=np.int32)
            self.at, self.used, self.new = np.concatenate([self.at, end]), np.concatenate([self.used, np.zeros(len(found), dtype=np.int64)]), []
        self.used += np.bincount(rows, minlength=len(self.used))
        counts = np.diff(self.at)[rows]
        total = np.concatenate([[0], np.cumsum(counts)])
        return gather(self.ids, self.at[rows], counts), np.diff(total[np.concatenate([[0], np.cumsum(size)])])

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.token.__getitem__, ids))


_TOOLS: dict[str, PrefixBPE] = {}
REMEMBERED.append(_TOOLS.clear)


def tool(path: str) -> PrefixBPE:
    if path not in _TOOLS:
        _TOOLS[path] = PrefixBPE(path)
    return _TOOLS[path]


def encode_texts(docs: DataFrame, tokenizer: str, decoded: bool = False) -> DataFrame:
    """docs with ids in place of text; decoded: and with the text that the ids decode to, in the same pass."""
    own = [f for f in docs.schema.fields if f.name not in ("text", "ids")]
    schema = T.StructType([*own, T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("text", T.StringType())] if decoded else [])])

    def run(batches):
        encoder = tool(tokenizer)
        for table in part_tables(batches, STEP_BYTES):
            flat, counts = encoder.encode(table["text"].to_pylist())
            at = np.concatenate([[0], np.cumsum(counts)])
            extra = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))]
            if decoded:
                extra.append(pa.array([encoder.decode(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays([*(table[f.name].combine_chunks() for f in own), *extra], names=schema.names)
        give_back()

    return docs.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """encoded (with a list of ids; null: none) with a text in place of it, and with ids still there."""
    own = [f for f in encoded.schema.fields if f.name != "text"]
    schema = T.StructType([*own, T.StructField("text", T.StringType())])

    def run(batches):
        decode = tool(tokenizer).decode
        for b in batches:
            texts = [decode(x or []) for x in b.column(b.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in own), pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)
