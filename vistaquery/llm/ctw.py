"""Language-model scores by context-tree weighting over binary-decomposed bytes.

The text that is modelled is the lower-cased words, joined by one space, and an end (a line
feed, which no word holds).  A byte is eight binary decisions along the path of its bits; each
of the 255 decision nodes has a context tree over the bytes before, down to `DEPTH` of them (at
the start: line feeds).  A node (context, decision) counts the training decisions for 0 and 1;
its estimate is Krichevsky-Trofimov's, and its weighted probability is half its own estimate
and half the product of its children's weighted probabilities (at full depth its own).  A
decision's probability mixes, along its path of contexts, the nodes' estimates by their
posterior weights; its base-2 logarithm is the code length.

Corpus counts: each part sends its distinct (context, byte) pairs with their training counts to
buckets by the two last bytes of the context, so a bucket holds whole subtrees, and its distinct
words with theirs to buckets by hash, where the words themselves are compared.  Counts are added
up in two steps, over a set number of parts (a salt) and then over the salts, so no task holds
what all parts say of a frequent context.  Bucket tasks build the subtrees; what stands above
(contexts of no and of one byte, at most 257 * 255 nodes) is summed by Spark and small for any
corpus.  Then each bucket's distinct log probabilities go to every salt, where the parts' pairs
look theirs up, and each part scores its own texts.

Null text: empty (its end alone).  Null doc_id: crc32 of the empty string is 0, so held out.
Equal doc_ids are scored row by row.  Repeated rows: each is
scored.  Empty table: no rows.  A text of any length is one row of one part.  Further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import bucket_count, free_shuffles, give_back, pack, stage, unpack, work_dir
from .words import LOWER, blocks

DEPTH = 5
#: Bytes of text for each bucket of the counts, and parts whose counts meet in one task.
BUCKET_BYTES, SALT_PARTS = 8 << 20, 64
_END = 0x0A
_BLOCK = 1 << 20
_HALF = math.log(0.5)
_U8 = np.uint64(8)


def held_out(ids: list) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids), dtype=bool, count=len(ids))


def symbols(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """For a block of canonical texts: key of each symbol (the DEPTH bytes before it, the last one
    highest, then the byte), and symbols of each text."""
    raw = np.frombuffer(b"".join(b"\n" * DEPTH + t for t in texts) + b"\n", dtype=np.uint8)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begin = np.cumsum(size + DEPTH) - size
    count = size + 1
    at = np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)
    wide = raw.astype(np.uint64)
    key = np.zeros(len(raw), dtype=np.uint64)
    for k in range(1, DEPTH + 1):
        key <<= _U8
        key[k:] |= wide[:-k]
    key = (key << _U8) | wide
    # a text's end is the first line feed of the next text's padding
    return key[at], count


def vocabulary(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the number of each word among them, words of each text."""
    split = [t.split() for t in texts]
    coded = pa.array(list(chain.from_iterable(split)), pa.binary()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.fromiter(map(len, split), dtype=np.int64, count=len(split))


def canonical(texts: list) -> list[bytes]:
    return [b" ".join(t.encode().translate(LOWER).split()) if t else b"" for t in texts]


def counted(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    v, c = np.concatenate(values), np.concatenate(counts)
    u, at = np.unique(v, return_inverse=True)
    return u, np.bincount(at, weights=c, minlength=len(u)).astype(np.int64)


def context_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    pair = keys >> np.uint64(8 * (DEPTH - 1))
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)


def word_bucket(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % n for w in words), dtype=np.int64, count=len(words))


def context_counts(texts: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct keys, in order, with their counts in training texts (0: only in others)."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in blocks(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), _BLOCK):
        key, n = symbols(texts[i:j])
        learn = np.repeat(train[i:j], n)
        for part, weight in ((key[learn], 1), (key[~learn], 0)):
            u, c = np.unique(part, return_counts=True)
            keys.append(u)
            counts.append(c * weight)
    return counted(keys, counts)


def pack_words(words: list[bytes]) -> bytes:
    return zlib.compress(b" ".join(words), 1)


def unpack_words(blob: bytes) -> list[bytes]:
    return zlib.decompress(blob).split()


def added(words: list[list[bytes]], counts: list[np.ndarray]) -> tuple[list[bytes], np.ndarray]:
    coded = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode()
    return coded.dictionary.to_pylist(), np.bincount(coded.indices.to_numpy(), weights=np.concatenate(counts), minlength=len(coded.dictionary)).astype(np.int64)


def log_gamma_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """lgamma(k + 1/2) - lgamma(1/2) and lgamma(k + 1) for k up to n."""
    k = np.arange(n, dtype=np.float64)
    return np.concatenate([[0], np.cumsum(np.log(k + 0.5))]), np.concatenate([[0], np.cumsum(np.log(k + 1))])


_SMALL = 1 << 12
_HALVES, _WHOLES = log_gamma_tables(_SMALL)


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones in any order."""

    def half(k):
        big = k > _SMALL
        out = _HALVES[np.where(big, 0, k)]
        out[big] = _stirling(k[big] + 0.5) - 0.5 * math.log(math.pi)
        return out

    n = a + b
    big = n > _SMALL
    whole = _WHOLES[np.where(big, 0, n)]
    whole[big] = _stirling(n[big] + 1.0)
    return half(a) + half(b) - whole


class Nodes:
    """The nodes of one context depth and bit: a row, a distinct (context, byte) in order, belongs
    to the node (context, path so far)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, k: int) -> None:
        path = keys >> np.uint64(8 - k)
        first = np.concatenate([[True], path[1:] != path[:-1]]) if len(keys) else np.zeros(0, bool)
        self.begins = np.flatnonzero(first)
        self.node = np.cumsum(first, dtype=np.int32) - np.int32(1)
        self.bit = ((keys >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
        self.a = np.add.reduceat(np.where(self.bit, 0, counts), self.begins) if len(keys) else counts
        self.b = np.add.reduceat(np.where(self.bit, counts, 0), self.begins) if len(keys) else counts


class Subtrees:
    """The trees below contexts of two bytes, for the keys of one bucket.

    The eight bits of a byte have trees of their own, so that those of one bit are held at a time."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts, self.ups = [keys], [counts], []
        for _ in range(DEPTH, 2, -1):  # drop the oldest byte of the context
            low = self.keys[-1]
            u, up = np.unique((low >> np.uint64(16) << _U8) | (low & np.uint64(0xFF)), return_inverse=True)
            self.keys.append(u)
            self.counts.append(np.bincount(up, weights=self.counts[-1], minlength=len(u)).astype(np.int64))
            self.ups.append(up.astype(np.int32))

    def _of_bit(self, k: int) -> tuple[list[Nodes], list[np.ndarray], np.ndarray]:
        """For every depth the nodes of bit k and the logs of their weights; the upper ones' log weighted products."""
        nodes, stay, weighted = [], [], None
        for d, (keys, counts) in enumerate(zip(self.keys, self.counts)):
            level = Nodes(keys, counts, k)
            own = log_kt(level.a, level.b)
            if d == 0:
                weighted = own
                stay.append(np.zeros(len(own)))
            else:
                # the node above each node below: that of any of its rows
                parent = level.node[self.ups[d - 1][nodes[-1].begins]]
                children = np.bincount(parent, weights=weighted, minlength=len(own))
                weighted = _HALF + np.logaddexp(own, children)
                stay.append(_HALF + own - weighted)
            nodes.append(level)
        return nodes, stay, weighted

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums for the contexts of one byte: node number (context, path), log weighted product of the children, zeros, ones."""
        number, product, a, b = [], [], [], []
        for k in range(8):
            nodes, _, weighted = self._of_bit(k)
            key = self.keys[-1][nodes[-1].begins]
            last_byte = (key >> np.uint64(16)) & np.uint64(0xFF)
            path = (np.uint64(1) << np.uint64(k)) | ((key & np.uint64(0xFF)) >> np.uint64(8 - k))
            number.append((last_byte << _U8 | path).astype(np.int64))
            product.append(weighted)
            a.append(nodes[-1].a)
            b.append(nodes[-1].b)
        return tuple(np.concatenate(x) for x in (number, product, a, b))

    def log10_probability(self, top: Top) -> np.ndarray:
        """Of the byte in its context, for each key."""
        keys = self.keys[0]
        total = np.zeros(len(keys))
        chain = [np.arange(len(total), dtype=np.int32)]
        for up in self.ups:
            chain.append(up[chain[-1]])
        x = (keys & np.uint64(0xFF)).astype(np.int64)
        last_byte = (keys >> np.uint64(8 * DEPTH)).astype(np.int64)
        for k in range(8):
            nodes, stays, _ = self._of_bit(k)
            bit, p = nodes[0].bit, None
            for level, log_stay, row in zip(nodes, stays, chain):
                node = level.node[row]
                a, b = level.a[node], level.b[node]
                own = (np.where(bit, b, a) + 0.5) / (a + b + 1.0)
                stay = np.exp(log_stay[node])
                p = own if p is None else stay * own + (1 - stay) * p
            del nodes, stays
            path = (1 << k) | (x >> (8 - k))
            for number in (last_byte * 256 + path, 65536 + path):
                one, stay = top.one[number], top.stay[number]
                p = stay * np.where(bit, one, 1 - one) + (1 - stay) * p
            total += np.log10(p)
        return total


class Top:
    """Estimates and weights of the nodes with a context of one byte (number: byte * 256 + path) and of none (65536 + path)."""

    def __init__(self, number: np.ndarray, product: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        n = 65536 + 256
        zeros, ones, children = (np.zeros(n, dtype=x) for x in (np.int64, np.int64, np.float64))
        zeros[number], ones[number], children[number] = a, b, product
        self.stay = np.zeros(n)
        weighted = self._weigh(slice(0, 65536), zeros, ones, children)
        for x, low in ((zeros, zeros), (ones, ones), (children, weighted)):
            x[65536:] = low[:65536].reshape(256, 256).sum(0)
        self._weigh(slice(65536, n), zeros, ones, children)
        self.one = (ones + 0.5) / (zeros + ones + 1.0)

    def _weigh(self, rows: slice, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> np.ndarray:
        own = log_kt(zeros[rows], ones[rows])
        weighted = _HALF + np.logaddexp(own, children[rows])
        self.stay[rows] = np.exp(_HALF + own - weighted)
        return weighted


class Table:
    """Values by 64-bit key, for lookups of whole arrays: open addressing, linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_value = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=values.dtype)
        taken = np.zeros(1 << bits, dtype=bool)
        at, rest = self._home(keys), np.arange(len(keys))
        while len(rest):
            want = at[rest]
            _, winner = np.unique(want, return_index=True)
            winner = winner[~taken[want[winner]]]
            put = rest[winner]
            self.slot_key[at[put]], self.slot_value[at[put]], taken[at[put]] = keys[put], values[put], True
            left = np.ones(len(rest), dtype=bool)
            left[winner] = False
            rest = rest[left]
            at[rest] = (at[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Of keys that are all there."""
        at = self._home(keys)
        rest = np.flatnonzero(self.slot_key[at] != keys)
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            rest = rest[self.slot_key[at[rest]] != keys[rest]]
        return self.slot_value[at]


SENT = "bucket int, salt int, part string, names binary, counts binary"
MERGED = "bucket int, names binary, counts binary, number long, product double, zeros long, ones long"


def _named(bucket: int, n: int, names) -> bytes:
    """Keys of a context bucket (numbers below n) or words of a word bucket."""
    return pack(np.diff(names, prepend=np.uint64(0))) if bucket < n else pack_words(names)


def _names(bucket: int, n: int, blob: bytes):
    return np.cumsum(unpack(blob, ["u8"])[0], dtype=np.uint64) if bucket < n else unpack_words(blob)


def score(docs: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes of every text."""
    spark = docs.sparkSession
    folder = work_dir(spark, "ctw")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged = stage(texts, folder)
    n = n_buckets or bucket_count(staged.bytes, BUCKET_BYTES)
    salts = max(1, -(-staged.n // SALT_PARTS))

    def keep(df: DataFrame, name: str, schema: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    def send(part: str) -> Iterator[pa.RecordBatch]:
        t = staged.read(part)
        texts, train = canonical(t["text"].to_pylist()), ~held_out(t["doc_id"].to_pylist())
        rows = []
        keys, counts = context_counts(texts, train)
        words, code, n_words = vocabulary(texts)
        word_counts = np.bincount(code, weights=np.repeat(train, n_words), minlength=len(words))
        salt = int(part[-8:], 16) % salts
        for names, c, bucket, first in ((keys, counts, context_bucket(keys, n).astype(np.int64), 0), (np.array(words, dtype=object), word_counts, word_bucket(words, n), n)):
            turn = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[turn], np.arange(n + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own = turn[cut[b] : cut[b + 1]]
                rows.append((b + first, salt, part, _named(b + first, n, names[own]), pack(c[own].astype(np.uint32))))
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["bucket", "salt", "part", "names", "counts"])

    sent = keep(staged.each(send, SENT), "sent", SENT)

    def merged_names(t: pa.Table, kind: str) -> tuple[int, object, np.ndarray]:
        b = t["bucket"][0].as_py()
        names, counts = [_names(b, n, x) for x in t["names"].to_pylist()], [unpack(x, [kind])[0] for x in t["counts"].to_pylist()]
        return (b, *(counted if b < n else added)(names, counts))

    def merge(t: pa.Table) -> pa.Table:
        give_back()
        b, names, counts = merged_names(t, "u4")
        return pa.table({"bucket": pa.array([b], pa.int32()), "names": [_named(b, n, names)], "counts": [pack(counts)]})

    def build(t: pa.Table) -> pa.Table:
        """A bucket's names and counts, and its sums for the nodes above (of words, as number -1: tokens and distinct words)."""
        give_back()
        b, names, counts = merged_names(t, "i8")
        number, product, zeros, ones = Subtrees(names, counts).top() if b < n else (np.array([-1]), np.zeros(1), counts.sum(keepdims=True), (counts > 0).sum(keepdims=True))
        k = len(number)
        own = pa.table({"bucket": pa.array([b], pa.int32()), "names": [_named(b, n, names)], "counts": [pack(counts)], "number": pa.nulls(1, pa.int64()), "product": pa.nulls(1, pa.float64()), "zeros": pa.nulls(1, pa.int64()), "ones": pa.nulls(1, pa.int64())})
        return pa.concat_tables([own, pa.table({"bucket": pa.array(np.full(k, b), pa.int32()), "names": pa.nulls(k, pa.binary()), "counts": pa.nulls(k, pa.binary()), "number": number.astype(np.int64), "product": product, "zeros": zeros, "ones": ones})])

    partial = sent.drop("part").repartition(min(2 * n * salts, 1 << 16), "bucket", "salt").groupBy("bucket", "salt").applyInArrow(merge, "bucket int, names binary, counts binary")
    merged = keep(partial.repartition(2 * n, "bucket").groupBy("bucket").applyInArrow(build, MERGED), "merged", MERGED)
    rows = merged.where("number is not null").groupBy("number").agg(F.sum("product").alias("product"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toPandas()  # 65,281 rows at most
    train_docs = texts.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0).count()
    words = rows[rows.number == -1]
    total, distinct = int(words.zeros.sum()) + train_docs, int(words.ones.sum()) + (train_docs > 0)
    rows = rows[rows.number >= 0]
    top = Top(rows.number.to_numpy(), rows["product"].to_numpy(), rows.zeros.to_numpy(), rows.ones.to_numpy())
    free_shuffles(staged)

    def known(batches):
        """Instead of counts of contexts: their log probabilities."""
        for t in batches:
            for b, names, counts in zip(*(t.column(k).to_pylist() for k in range(3))):
                if b < n:
                    counts = pack(Subtrees(_names(b, n, names), unpack(counts, ["i8"])[0]).log10_probability(top))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "names": pa.array([names], pa.binary()), "values": pa.array([counts], pa.binary())})
            give_back()

    def look_up(asked: pa.Table, model: pa.Table) -> pa.Table:
        b, blob = model["bucket"][0].as_py(), model["values"][0].as_py()
        names, values = _names(b, n, model["names"][0].as_py()), unpack(blob, ["f8" if b < n else "i8"])[0]
        number = None if b < n else {w: i for i, w in enumerate(names)}
        out = []
        for x in asked["names"].to_pylist():
            own = _names(b, n, x)
            out.append(pack(values[np.searchsorted(names, own) if b < n else [number[w] for w in own]]))
        return pa.table({"part": asked["part"], "bucket": asked["bucket"], "names": asked["names"], "values": pa.array(out, pa.binary())})

    model = merged.where("number is null").select("bucket", "names", "counts").repartition(2 * n, "bucket").mapInArrow(known, "bucket int, names binary, values binary").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    k = min(2 * n * salts, 1 << 16)
    back = sent.drop("counts").repartition(k, "bucket", "salt").groupBy("bucket", "salt").cogroup(model.repartition(k, "bucket", "salt").groupBy("bucket", "salt")).applyInArrow(lambda asked, model: look_up(asked, model) if asked.num_rows else ANSWERS.empty_table(), "part string, bucket int, names binary, values binary")

    def scored(t: pa.Table) -> pa.Table:
        give_back(forget=True)
        staged_rows = staged.read(t["part"][0].as_py())
        keys, log_p, held = [np.zeros(0, np.uint64)], [np.zeros(0)], {}
        for b, names, values in zip(*(t[c].to_pylist() for c in ("bucket", "names", "values"))):
            if b < n:
                keys.append(_names(b, n, names))
                log_p.append(unpack(values, ["f8"])[0])
            else:
                held.update(zip(unpack_words(names), unpack(values, ["i8"])[0].tolist()))
        model = Table(np.concatenate(keys), np.concatenate(log_p))
        texts, ids = canonical(staged_rows["text"].to_pylist()), staged_rows["doc_id"].to_pylist()
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "n_bytes")}
        whole = total + 0.1 * (distinct + 1)
        for i, j in blocks(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), _BLOCK):
            key, n_symbols = symbols(texts[i:j])
            words, code, n_words = vocabulary(texts[i:j])
            at, word_at = np.cumsum(n_symbols) - n_symbols, np.concatenate([[0], np.cumsum(n_words)])
            out["score"].append(np.add.reduceat(model.get(key), at))
            c = np.fromiter((held[w] for w in words), dtype=np.int64, count=len(words))[code]
            filled = np.flatnonzero(n_words)
            for name, each, end in (("base_score", np.log10((c + 0.1) / whole), math.log10((train_docs + 0.1) / whole)), ("n_known", (c > 0).astype(np.int64), int(train_docs > 0))):
                own = np.full(j - i, end)
                if len(filled):  # summed text by text, so that no text takes on another's rounding
                    own[filled] += np.add.reduceat(each, word_at[:-1][filled])
                out[name].append(own)
            out["n_tokens"].append(n_words + 1)
            out["n_bytes"].append(n_symbols)
        got = {k: np.concatenate(v) for k, v in out.items()}
        return pa.table({"doc_id": staged_rows["doc_id"], "held_out": held_out(ids), "n_tokens": got["n_tokens"], "n_known": got["n_known"].astype(np.int64), "train_tokens": np.full(len(ids), total), "base_score": got["base_score"], "score": got["score"], "n_bytes": got["n_bytes"]})

    return back.repartition(max(2 * staged.n, 1), "part").groupBy("part").applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")


ANSWERS = pa.schema([("part", pa.string()), ("bucket", pa.int32()), ("names", pa.binary()), ("values", pa.binary())])
