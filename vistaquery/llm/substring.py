"""Substring dedup with a log-structured fingerprint index.

A window is `size` consecutive words of one document.  Documents come in batches.  Parts of a
batch send the fingerprints of their windows to buckets.  A bucket's task sorts them and
merge-joins them with that bucket of each sorted, immutable run of the index: a window whose
fingerprint is in a run, or earlier in the batch (smaller doc_id, then place), claims that it
equals the window there.  Fingerprints are 56 bits, and a run holds the place of each, so that
every claim is verified on the words themselves: claims of one stretch of words go with those
words to the part they point at and are compared there.  A window whose claim fails, as two
windows have one fingerprint, is compared by words with all others of that kind.  What was new
becomes a further run, and when there are too many runs the two smallest neighbours are
compacted to one.  Then each part drops the words that a repeated window covers.

Null text: no words.  Null doc_id: before all others.  Equal doc_ids: in order of a 64-bit
digest of their texts, in whatever parts they are.  Equal rows: any order, as results are the
same.  Empty table: no rows.  Further columns stay; columns named n_words or n_removed are
replaced.  A text of any length is one row of one part.  Documents of earlier calls on the same
index are earlier than all of a later call.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import Staged, bucket_count, free_shuffles, give_back, pack, put_parquet, read_parquet, remove, stage, unpack, work_dir
from .words import Hasher, Words, blocks, split_words, text_lengths

WINDOW, MAX_RUNS = 20, 2
#: Bytes of text in a batch, as long as there are from 2 to 4 batches: every batch reads the whole index.
BATCH_BYTES = 64 << 20
#: Bytes of text for each bucket of the index.
BUCKET_BYTES = 6 << 20
_KEY, _KEY_BITS = Hasher(11), 56
_BLOCK = 1 << 20
_NULL_ID = np.iinfo(np.int64).min


def copies(texts: list) -> np.ndarray:
    """Which texts equal an earlier one of the same part: their windows all start earlier."""
    seen: set = set()
    return np.fromiter((x in seen or seen.add(x) is not None for x in texts), dtype=bool, count=len(texts))


def keys_of(column: pa.Array, skip: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By block of texts: the fingerprint, the text and the first word (numbered over the column) of each window."""
    before = 0
    for i, j in blocks(text_lengths(column), _BLOCK):
        w = split_words(column.slice(i, j - i))
        count = np.maximum(np.diff(w.offsets) - size + 1, 0)
        count[skip[i:j]] = 0
        doc = np.repeat(np.arange(j - i), count)
        at = w.offsets[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        keys = _KEY.windows(_KEY.words(w.data, w.start, w.end), size)[at] >> np.uint64(64 - _KEY_BITS) if len(at) else np.zeros(0, np.uint64)
        yield keys, (doc + i).astype(np.int32), (at + before).astype(np.int32)
        before += int(w.offsets[-1])


def _drained(pieces: list, kind: type) -> np.ndarray:
    """The pieces as one array; the list is empty afterwards."""
    out = np.concatenate(pieces or [np.zeros(0)]).astype(kind, copy=False)
    pieces.clear()
    return out


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(_KEY_BITS - 24)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def words_at(w: Words, first: int, n: int) -> bytes:
    """n words from the first one on, joined by one space."""
    return b" ".join(w.data[w.start[first] : w.end[first + n - 1]].tobytes().split()) if first + n <= len(w.start) else b""


CLAIMS = "part string, there string, b array<int>, a array<int>"
SEGMENTS = "part string, there string, a int, n int, b array<int>, words binary"
#: Kinds of marks: windows that repeat, windows that don't after all, and single ones that do.
REPEATED, FAILED, ALONE = 0, 1, 2


@dataclass
class Batch:
    staged: Staged
    marks: DataFrame
    size: int
    schema: T.StructType

    def cleaned(self, joined: bool = True) -> DataFrame:
        """The batch without the words that a repeated window covers, with n_words and n_removed."""
        staged, size = self.staged, self.size
        own = [f.name for f in self.schema.fields if f.name not in ("text", "n_words", "n_removed")]

        def part(name: pa.Table, marks: pa.Table) -> pa.Table:
            give_back(forget=True)
            t = staged.read(name["part"][0].as_py())
            text = t["text"].combine_chunks()
            same = copies(text.to_pylist())
            kind, b, n = (marks[c].to_numpy() for c in ("kind", "b", "n"))
            w = split_words(text)
            edge = np.zeros(len(w.start) + 1, dtype=np.int64)
            if (kind != REPEATED).any():  # rare: by window
                many = np.bincount(np.repeat(np.where(kind != FAILED, b, 0), np.where(kind != FAILED, n, 0)) + _within(np.where(kind != FAILED, n, 0)), minlength=len(w.start))
                many[b[kind == FAILED]] = 0
                many[b[kind == ALONE]] = 1
                b = np.flatnonzero(many)
                n = np.ones(len(b), dtype=np.int64)
            np.add.at(edge, b, 1)
            np.add.at(edge, b + n + size - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.offsets])
            n_words = np.diff(w.offsets)
            lost = np.where(same & (n_words >= size), n_words, lost)
            texts = []
            for k, (i, j, x) in enumerate(zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), lost.tolist())):
                raw = text[k].as_py()
                if x and x == j - i:
                    texts.append("")
                elif x:
                    texts.append(b" ".join(compress(raw.encode().split(), ~gone[i:j])).decode())
                else:
                    texts.append(b" ".join(raw.encode().split()).decode() if joined and raw else ("" if joined else raw))
            return pa.table([*(t[c] for c in own), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(lost, pa.int64())], names=[*own, "text", "n_words", "n_removed"])

        out = T.StructType([*(f for f in self.schema.fields if f.name in own), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
        k = max(staged.n, 1)
        return staged.parts().select("part").repartition(k, "part").groupBy("part").cogroup(self.marks.repartition(k, "part").groupBy("part")).applyInArrow(part, out)


def _within(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


@dataclass
class FingerprintIndex:
    """Runs of the window fingerprints of all documents so far; a run is a folder with a sorted file for each bucket.

    Staged parts stay in the index's folder, as claims are verified on their words."""

    spark: SparkSession
    n_buckets: int
    size: int = WINDOW
    max_runs: int = MAX_RUNS
    folder: str = ""
    runs: list[str] = field(default_factory=list)
    weights: list[int] = field(default_factory=list)
    odd: DataFrame | None = None

    def __post_init__(self) -> None:
        self.folder = self.folder or work_dir(self.spark, "fingerprints")

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def _sent(self, staged: Staged, order: str) -> DataFrame:
        """bucket, part and entries: the fingerprints and places of the part's windows in that bucket, by document."""
        n, size = self.n_buckets, self.size

        def send(part: str) -> Iterator[pa.RecordBatch]:
            t = staged.read(part, [order, "text"])
            text = t["text"].combine_chunks()
            texts = text.to_pylist()
            columns = [list(x) for x in zip(*keys_of(text, copies(texts), size))] or [[], [], []]
            keys, doc, at = (_drained(x, kind) for x, kind in zip(columns, (np.uint64, np.int32, np.int32)))
            bucket = bucket_of(keys, n).astype(np.int32)
            turn = np.argsort(bucket, kind="stable").astype(np.int32)
            cut = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n))])
            del bucket
            keys, doc, at = keys[turn], doc[turn], at[turn]
            del turn
            ids = t[order].combine_chunks().fill_null(_NULL_ID).to_numpy()
            tie = np.array([int.from_bytes(hashlib.blake2b((x or "").encode(), digest_size=8).digest(), "little") for x in texts], dtype=np.uint64)
            full = np.flatnonzero(np.diff(cut))
            out = []
            for k in full:
                a, b = cut[k], cut[k + 1]
                begin = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
                here = doc[a:b][begin]
                out.append(pack(keys[a:b], np.diff(at[a:b], prepend=0).astype(np.int32), np.diff(ids[here], prepend=0), tie[here], np.diff(np.append(begin, b - a)).astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([part] * len(full), pa.string()), pa.array(out, pa.binary())], names=["bucket", "part", "entries"])

        return staged.each(send, "bucket int, part string, entries binary")

    def add(self, docs: DataFrame, keep_run: bool = True) -> Batch:
        """Stages a batch, marks its repeated windows and, if asked to, makes its new ones a run."""
        size, folder, runs, name = self.size, self.folder, list(self.runs), uuid.uuid4().hex[:12]
        order = max([*docs.columns, "a"], key=len) + "_order"  # a name that no column has
        staged = stage(docs.withColumn(order, F.col("doc_id").cast("long")), folder, f"batch{name}", [order, "text"])
        run = f"{folder}/run{name}"

        def bucket(t: pa.Table) -> pa.Table:
            """Claims, and the new windows in a file of the run."""
            b = t["bucket"][0].as_py()
            t = t.sort_by("part")
            parts = t["part"].to_pylist()
            got = [unpack(x, ["u8", "i4", "i8", "u8", "u4"]) for x in t["entries"].to_pylist()]
            count = [len(g[0]) for g in got]
            keys = np.concatenate([g[0] for g in got])
            at = np.concatenate([np.cumsum(g[1], dtype=np.int64) for g in got])
            of = np.repeat(np.arange(len(got)), count)
            ids, tie, many = np.concatenate([np.cumsum(g[2]) for g in got]), np.concatenate([g[3] for g in got]), np.concatenate([g[4] for g in got]).astype(np.int64)
            turn = np.lexsort((tie, ids))
            rank = np.empty(len(ids), dtype=np.int64)
            rank[turn] = np.arange(len(ids))
            place = np.repeat(rank, many)
            turn = np.lexsort((at, place, keys))
            keys, at, of = keys[turn], at[turn], of[turn]
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            own = keys[begin]
            target, where = of[begin].copy(), at[begin].copy()  # what each key's windows claim to equal
            names, old = list(parts), np.zeros(len(own), dtype=bool)
            for path in runs:
                r = _read_run(f"{path}/{b:07}")
                run_keys = r["key"].to_numpy().astype(np.uint64)
                i = np.minimum(np.searchsorted(run_keys, own), max(len(run_keys) - 1, 0))
                hit = np.flatnonzero(run_keys[i] == own) if len(run_keys) else np.zeros(0, np.int64)
                there = pc.dictionary_encode(r["part"].combine_chunks().take(pa.array(i[hit])))
                target[hit] = there.indices.to_numpy() + len(names)
                names += there.dictionary.to_pylist()
                where[hit] = r["at"].to_numpy()[i[hit]]
                old[hit] = True
            if keep_run:
                new = begin[~old]
            if keep_run and len(new):
                _write_run(f"{run}/{b:07}", keys[new], pa.DictionaryArray.from_arrays(pa.array(of[new], pa.int32()), pa.array(parts, pa.string())), at[new])
            each = np.cumsum(np.isin(np.arange(len(keys)), begin)) - 1
            claim = np.ones(len(keys), dtype=bool)
            claim[begin[~old]] = False
            of, there, here, at = of[claim], target[each[claim]], at[claim], where[each[claim]]
            turn = np.lexsort((here, there, of))
            of, there, here, at = of[turn], there[turn], here[turn], at[turn]
            cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (there[1:] != there[:-1])])) if len(of) else np.zeros(0, np.int64)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(cut, len(of)).astype(np.int32)), pa.array(x, pa.int32()))
            return pa.table({"part": pa.array([parts[x] for x in of[cut]], pa.string()), "there": pa.array([names[x] for x in there[cut]], pa.string()), "b": lists(here), "a": lists(at)})

        if keep_run:
            _make(run)
        claims = self._keep(self._sent(staged, order).repartition(self.n_buckets, "bucket").groupBy("bucket").applyInArrow(bucket, CLAIMS), f"claims{name}")
        free_shuffles(staged)
        if keep_run:
            self.runs.append(run)
            self.weights.append(staged.bytes)
        marks = self._verified(staged, claims, order, name)
        remove(f"{folder}/claims{name}")
        free_shuffles(staged)
        while len(self.runs) > self.max_runs:
            self.compact()
        return Batch(staged, marks, size, docs.schema)

    def _verified(self, staged: Staged, claims: DataFrame, order: str, name: str) -> DataFrame:
        """Compares the words of claims; the batch's marks."""
        size, folder = self.size, self.folder

        def segments(t: pa.Table) -> pa.Table:
            """Claims of a part as stretches of windows that follow one another here and there, each with its words once."""
            give_back()
            part, names = t["part"][0].as_py(), t["there"].to_pylist()
            n = pc.list_value_length(t["b"]).to_numpy()
            b, a = (t[c].combine_chunks().flatten().to_numpy() for c in ("b", "a"))
            there = np.repeat(np.unique(np.array(names, dtype=object), return_inverse=True)[1].astype(np.int32), n)
            row = np.repeat(np.arange(len(names), dtype=np.int32), n)
            turn = np.argsort(b, kind="stable").astype(np.int32)
            b, a, there, row = b[turn], a[turn], there[turn], row[turn]
            del turn
            begin = np.flatnonzero(np.concatenate([[True], (np.diff(b) != 1) | (np.diff(a) != 1) | (np.diff(there) != 0)]))
            length = np.diff(np.append(begin, len(b)))
            w, found = split_words(staged.read(part, ["text"])["text"].combine_chunks()), {}
            for i, k in zip(begin.tolist(), length.tolist()):
                found.setdefault((names[row[i]], int(a[i]), k, words_at(w, int(b[i]), k + size - 1)), []).append(int(b[i]))
            x = list(zip(*found))
            return pa.table({"part": pa.array([part] * len(found), pa.string()), "there": pa.array(x[0], pa.string()), "a": pa.array(x[1], pa.int32()), "n": pa.array(x[2], pa.int32()), "b": pa.array(list(found.values()), pa.list_(pa.int32())), "words": pa.array(x[3], pa.binary())})

        def failed(t: pa.Table) -> pa.Table:
            """Windows whose words are not those they claim to equal."""
            give_back()
            out = []
            w = split_words(read_parquet(f"{folder}/{t['there'][0].as_py()}", ["text"])["text"].combine_chunks())
            for part, a, n, b, words in zip(*(t[c].to_pylist() for c in ("part", "a", "n", "b", "words"))):
                if words_at(w, a, n + size - 1) == words:
                    continue
                own = words.split()
                for k in range(n):
                    if words_at(w, a + k, size) != (x := b" ".join(own[k : k + size])):
                        out += [(part, i + k, x) for i in b]
            return pa.table([pa.array([x[c] for x in out], kind) for c, kind in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["part", "b", "words"])

        k = max(staged.n, 1)
        found = self._keep(claims.repartition(k, "part").groupBy("part").applyInArrow(segments, SEGMENTS), f"segments{name}")
        odd = self._keep(found.repartition(2 * k, "there").groupBy("there").applyInArrow(failed, "part string, b int, words binary"), f"odd{name}")
        marks = found.select("part", F.lit(REPEATED).cast("byte").alias("kind"), F.explode("b").alias("b"), "n")
        one = F.lit(1).alias("n")
        if not odd.isEmpty():
            marks = marks.unionByName(odd.select("part", F.lit(FAILED).cast("byte").alias("kind"), "b", one))
            again = self._among_odd(staged, odd, order, name)
            marks = marks.unionByName(again.select("part", F.lit(ALONE).cast("byte").alias("kind"), "b", one))
        return marks

    def _among_odd(self, staged: Staged, odd: DataFrame, order: str, name: str) -> DataFrame:
        """Of windows that differ from the first of their fingerprint, those that equal an earlier one of the kind, by words."""

        def placed(t: pa.Table) -> pa.Table:
            docs = staged.read(t["part"][0].as_py(), [order, "text"])
            w = split_words(docs["text"].combine_chunks())
            doc = np.searchsorted(w.offsets, t["b"].to_numpy(), side="right") - 1
            tie = [int.from_bytes(hashlib.blake2b((x or "").encode(), digest_size=8).digest(), "little") - (1 << 63) for x in docs["text"].to_pylist()]
            return t.append_column("id", docs[order].combine_chunks().take(pa.array(doc))).append_column("tie", pa.array([tie[x] for x in doc], pa.int64()))

        rows = odd.groupBy("part").applyInArrow(placed, "part string, b int, words binary, id long, tie long")
        rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("words").orderBy(F.col("id").asc_nulls_first(), "tie", "part", "b")))
        if self.odd is not None:
            rows = rows.join(self.odd.withColumn("known", F.lit(True)), "words", "left").withColumn("turn", F.when(F.col("known"), 2).otherwise(F.col("turn")))
        rows = self._keep(rows.select("part", "b", "words", "turn"), f"placed{name}")
        new = rows.where("turn = 1").select("words")
        self.odd = new if self.odd is None else self.odd.unionByName(new)
        return rows.where("turn > 1")

    def compact(self) -> None:
        """Merges the two smallest runs that follow one another."""
        k = min(range(len(self.runs) - 1), key=lambda i: self.weights[i] + self.weights[i + 1])
        a, b, path = self.runs[k], self.runs[k + 1], f"{self.folder}/run{uuid.uuid4().hex[:12]}"

        def merge(batches):
            for x in batches:
                for k in x.column(0).to_pylist():
                    both = pa.concat_tables([_read_run(f"{r}/{k:07}") for r in (a, b)])
                    both = both.take(np.argsort(both["key"].to_numpy(), kind="stable"))
                    _write_run(f"{path}/{k:07}", both["key"].to_numpy(), both["part"].combine_chunks(), both["at"].to_numpy())
                    give_back()
                yield x

        _make(path)
        self.spark.range(0, self.n_buckets, 1, max(1, self.n_buckets // 4)).mapInArrow(merge, "id long").count()
        remove(a)
        remove(b)
        self.runs[k : k + 2] = [path]
        self.weights[k : k + 2] = [self.weights[k] + self.weights[k + 1]]

    def drop(self) -> None:
        """The runs go; the staged parts stay, as batches read them."""
        for path in self.runs:
            remove(path)
        self.runs, self.weights = [], []


def _make(path: str) -> None:
    from .work import locate

    fs, p = locate(path)
    fs.create_dir(p, recursive=True)


def _read_run(path: str) -> pa.Table:
    """A run has no file for a bucket in which nothing was new."""
    try:
        return read_parquet(path)
    except FileNotFoundError:
        return pa.table({"key": pa.array([], pa.int64()), "part": pa.array([], pa.string()), "at": pa.array([], pa.int32())})


def _write_run(path: str, keys: np.ndarray, parts: pa.Array, at: np.ndarray) -> None:
    """Sorted keys are delta-encoded, part names a dictionary."""
    t = pa.table({"key": keys.astype(np.int64), "part": parts.cast(pa.string()) if not pa.types.is_dictionary(parts.type) else parts, "at": pa.array(at, pa.int32())})
    put_parquet(path, t, use_dictionary=["part"], column_encoding={"key": "DELTA_BINARY_PACKED", "at": "BYTE_STREAM_SPLIT"})


def dedup_substrings(docs: DataFrame, size: int = WINDOW, batches: int | None = None, n_buckets: int | None = None, joined: bool = True, folder: str = "") -> DataFrame:
    """docs without the words of windows that also start earlier; with n_words and n_removed.

    joined: kept words are joined by one space in every text; else texts that lose nothing stay
    as they are.  The index is built anew, in so many batches by doc_id, and dropped.  More batches
    need less disk for the exchange and read the runs more often.  folder: where all of it is."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = n_buckets or bucket_count(n_bytes, BUCKET_BYTES)
    batches = batches or min(max(2, -(-n_bytes // BATCH_BYTES)), 4)
    index = FingerprintIndex(spark, n_buckets, size, folder=folder)
    cuts = sorted({*docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)}) if batches > 1 else []
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges[:-1], edges[1:]):
        here = F.lit(True) if low is None and high is None else F.coalesce((F.lit(True) if low is None else F.col("doc_id") >= low) & (F.lit(True) if high is None else F.col("doc_id") < high), F.lit(low is None))
        out.append(index.add(docs.where(here), keep_run=high is not None).cleaned(joined))
    index.drop()
    return reduce(DataFrame.unionByName, out)
