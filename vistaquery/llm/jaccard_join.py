"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters.

A document's set is its distinct word n-grams (with fewer words: all of them as one; without
any: empty, linked with nothing).  Two sets link when 100 * intersection >= percent * union.

1. Documents are staged.  Documents of the same words are one set, told apart by a 128-bit
   digest of the words; all that follows reads one document of each.
2. Parts send their distinct n-grams, by hash, to buckets, which count in how many sets each
   is (exactly, over all sets) and send the counts back.  A set's elements in order of count,
   then hash, are rare-first and in the same order everywhere.  Two n-grams of one hash in a
   set are two elements, so a collision costs a comparison and never a link.
3. Each set's prefix goes to Spark as rows, but for n-grams that no other set holds.  Of the
   sets that share an element the smallest leads: the others pair with it.  Pairs pass the
   length and positional filters and, once per pair, a bound from counts of their shared
   elements in 64 ranges.  One side's words travel to the other's part, and there the suffix
   filter and then the words' n-grams themselves decide.  Links join sets to components.
4. All pairs of different components that lists still hold go the same way, so every link
   between components is found; links inside one change nothing.  A list's largest component
   is not paired with itself, and lists of over BLOCK sets are dealt to pairs of blocks.

Null text: empty.  Null doc_id: never the smallest of others; alone, its component is null.
Equal doc_ids: each row has its own set.  Empty table: no rows.  Further columns stay,
whatever their names.  A text of any length is one row of one part; parts are cut by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .work import Staged, bucket_count, free_shuffles, pack, remove, stage, unpack, work_dir
from .words import NON_SPACE, Hasher, blocks, digest_of_words, lanes, mix, split_words, text_lengths

RANGES = 64
#: Bytes of text for each bucket of the counts, sets of a list in one task, and pairs compared in one task.
BUCKET_BYTES, BLOCK, CHUNK = 6 << 20, 8192, 2000
#: Levels of the suffix filter's recursion.
DEPTH = 3
_HASH = Hasher(31)
_BYTES = 1 << 20
_WIDE = np.int64(1) << 40


def _starts(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count[0] - 1, 0, 1, ..."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def grams(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By block of texts: first text, texts, and the elements of their sets (text within the block, hash), in order."""
    for i, j in blocks(text_lengths(column), _BYTES):
        w = split_words(column.slice(i, j - i), lower=True)
        x, y = lanes(w.data, w.start, w.end)
        length = w.end - w.start
        h = _HASH.of_lanes(x, y, length)
        n = np.diff(w.offsets)
        count = np.maximum(n - size + 1, 0)
        doc = np.repeat(np.arange(j - i), count)
        at = w.offsets[:-1][doc] + _starts(count)
        token = _HASH.windows(h, size)[at] if len(at) else np.zeros(0, np.uint64)
        for k in range(1, size):  # shorter texts: all words as one
            own = np.flatnonzero(n == k)
            if len(own):
                token = np.concatenate([token, _HASH.windows(h, k)[w.offsets[:-1][own]]])
                doc, at = np.concatenate([doc, own]), np.concatenate([at, w.offsets[:-1][own]])
        order = np.lexsort((token, doc))
        token, doc, at = token[order], doc[order], at[order]
        same = np.flatnonzero((token[1:] == token[:-1]) & (doc[1:] == doc[:-1])) + 1
        equal = np.ones(len(same), dtype=bool)
        for k in range(size):
            a, b = at[same] + k, at[same - 1] + k
            equal &= (x[a] == x[b]) & (y[a] == y[b]) & (length[a] == length[b])
        keep = np.ones(len(token), dtype=bool)
        keep[same] = False
        if not equal.all():  # n-grams of one hash that differ: the second one is an element of its own, and so on
            seen: dict[tuple[int, int], dict[tuple, int]] = {}
            for k in np.unique(np.concatenate([same, same - 1])).tolist():
                gram = tuple((int(x[a]), int(y[a]), int(length[a])) for a in range(at[k], at[k] + size))
                known = seen.setdefault((int(doc[k]), int(token[k])), {})
                keep[k] = gram not in known
                number = known.setdefault(gram, len(known))
                if number and keep[k]:
                    token[k] = mix(token[k : k + 1] + np.uint64(number))[0]
        token, doc = token[keep], doc[keep]
        if not equal.all():
            order = np.lexsort((token, doc))
            token, doc = token[order], doc[order]
        yield i, j - i, doc, token


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """A set that links with this one shares at least ceil(percent n / 100) elements, so one of the first so many."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of linked sets of n and m elements."""
    return -(-percent * (n + m) // (100 + percent))


def may_link(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Length filter, and positional filter for an element at p of n and at q of m."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - p, m - q) >= needed(n, m, percent))


def exact_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Of each text its set of n-grams: sorted numbers that are equal for equal words alone."""
    w = split_words(pa.array(texts, pa.large_binary()), lower=True)
    length, n = w.end - w.start, np.diff(w.offsets)
    at = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    body = np.ascontiguousarray(w.data[NON_SPACE[w.data]])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(at), pa.py_buffer(body)]).dictionary_encode()
    word = words.indices.to_numpy().astype(np.int64)
    count = np.maximum(n - size + 1, 0)
    doc = np.repeat(np.arange(len(texts)), count)
    begin = w.offsets[:-1][doc] + _starts(count)
    gram = word[begin] if len(begin) else np.zeros(0, np.int64)
    for k in range(1, size):
        gram = np.unique(gram * max(len(words.dictionary), 1) + word[begin + k], return_inverse=True)[1] if len(begin) else gram
    out = [np.unique(x) for x in np.split(gram, np.cumsum(count)[:-1])] if texts else []
    short: dict[tuple, int] = {}
    for k in np.flatnonzero((n > 0) & (n < size)).tolist():
        out[k] = np.array([-1 - short.setdefault(tuple(word[w.offsets[k] : w.offsets[k + 1]].tolist()), len(short))])
    return out


def differing(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> int:
    """The suffix filter's bound: at least so many elements are in one of two sorted arrays alone."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    j = len(y) // 2
    i = int(np.searchsorted(x, y[j]))
    hit = i < len(x) and x[i] == y[j]
    return differing(x[:i], y[:j], depth - 1) + (not hit) + differing(x[i + hit :], y[j + 1 :], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link: suffix filter, then their intersection."""
    need = int(needed(np.int64(len(x)), np.int64(len(y)), percent))
    if differing(x, y) > len(x) + len(y) - 2 * need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(values)))


@dataclass
class Join:
    """The result: meta has a row per document (part, ord, doc_id, n_shingles, component_id, component).

    component is a component's own key; component_id, its smallest doc_id, may be null or another's too."""

    staged: Staged
    meta: DataFrame
    schema: object

    def representatives(self) -> DataFrame:
        """The columns of the documents, of one row of each component (and of each document without words)."""
        names, staged = [f.name for f in self.schema.fields], self.staged
        first = self.meta.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "part", "ord")).alias("x")).select("x.part", "x.ord")
        kept = first.unionByName(self.meta.where("n_shingles = 0").select("part", "ord"))

        def part(t: pa.Table) -> pa.Table:
            return staged.read(t["part"][0].as_py(), names).take(pa.array(np.sort(t["ord"].to_numpy())))

        return kept.repartition(max(2 * staged.n, 1), "part").groupBy("part").applyInArrow(part, self.schema)

    def drop(self) -> None:
        """The staged files and tables go; meta and what comes from it can't be read any more."""
        remove(self.staged.folder)


META = "part string, ord int, doc_id long, sig binary"
TOKENS = "id long, n int, token long, pos int, sketch binary"
PAIRS = "a long, b long, part_a string, ord_a int, part_b string, ord_b int"


def _bounded(percent: int):
    """Of pairs with their sketches, those whose shared elements may be enough."""

    def run(batches):
        for t in batches:
            n, m = (t.column(k).to_numpy().astype(np.int64) for k in (6, 8))
            if not len(n):
                continue
            x, y = (np.frombuffer(b"".join(t.column(k).to_pylist()), dtype=np.uint8).reshape(-1, RANGES) for k in (7, 9))
            ok = (np.minimum(x, y).sum(1, dtype=np.int64) >= needed(n, m, percent)) | (x.max(1) == 255) | (y.max(1) == 255)
            yield pa.RecordBatch.from_arrays(t.columns[:6], names=t.schema.names[:6]).filter(pa.array(ok))

    return run


def _counts(staged: Staged, sets: DataFrame, size: int, n_buckets: int) -> DataFrame:
    """part, bucket and counts: in how many sets each of the part's n-grams in that bucket is, in order of hash."""

    def send(t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        text = staged.read(part, ["text"])["text"].combine_chunks().take(pa.array(np.sort(t["ord"].to_numpy())))
        token, n = np.unique(np.concatenate([g[3] for g in grams(text, size)] or [np.zeros(0, np.uint64)]), return_counts=True)
        cut = np.searchsorted(((token >> np.uint64(40)) * np.uint64(n_buckets)) >> np.uint64(24), np.arange(n_buckets + 1))
        full = np.flatnonzero(np.diff(cut))
        out = [pack(np.diff(token[cut[b] : cut[b + 1]], prepend=np.uint64(0)), n[cut[b] : cut[b + 1]].astype(np.uint32)) for b in full]
        return pa.table({"bucket": pa.array(full, pa.int32()), "part": pa.array([part] * len(full), pa.string()), "tokens": pa.array(out, pa.binary())})

    def count(t: pa.Table) -> pa.Table:
        got = [unpack(x, ["u8", "u4"]) for x in t["tokens"].to_pylist()]
        token, n = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got]), np.concatenate([g[1] for g in got])
        _, at = np.unique(token, return_inverse=True)
        total = np.minimum(np.bincount(at, weights=n), 65535).astype(np.uint16)[at]
        out = [pack(x) for x in np.split(total, np.cumsum([len(g[0]) for g in got])[:-1])]
        return pa.table({"part": t["part"], "bucket": t["bucket"], "counts": pa.array(out, pa.binary())})

    sent = sets.select("part", "ord").repartition(max(staged.n, 1), "part").groupBy("part").applyInArrow(send, "bucket int, part string, tokens binary")
    return sent.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(count, "part string, bucket int, counts binary")


def _prefixes(staged: Staged, sets: DataFrame, counts: DataFrame, size: int, percent: int) -> DataFrame:
    """A row per set (id, n, sketch), and one per element of its prefix that another set holds too (id, n, token, pos)."""

    def part(own: pa.Table, back: pa.Table) -> pa.Table:
        own = own.sort_by("ord")
        text = staged.read(own["part"][0].as_py(), ["text"])["text"].combine_chunks().take(own["ord"].combine_chunks())
        ids, held = own["id"].to_numpy(), list(grams(text, size))
        every = np.unique(np.concatenate([g[3] for g in held]))
        in_sets = np.concatenate([unpack(x, ["u2"])[0] for x in back.sort_by("bucket")["counts"].to_pylist()])
        out = []
        for i, texts, doc, token in held:
            df = in_sets[np.searchsorted(every, token)]
            order = np.lexsort((token, df, doc))
            token, df = token[order], df[order]
            n = np.bincount(doc, minlength=texts)
            pos, shared = _starts(n), df > 1
            go = shared & (pos < np.repeat(prefix_length(n, percent), n))
            in_range = np.bincount(doc[shared] * RANGES + (token[shared] & np.uint64(RANGES - 1)).astype(np.int64), minlength=texts * RANGES)
            sketch = np.minimum(in_range, 255).astype(np.uint8).reshape(texts, RANGES)
            own_ids, k = ids[i : i + texts], int(go.sum())
            out.append(pa.table({"id": own_ids, "n": pa.array(n, pa.int32()), "token": pa.nulls(texts, pa.int64()), "pos": pa.nulls(texts, pa.int32()), "sketch": pa.array([x.tobytes() for x in sketch], pa.binary())}))
            out.append(pa.table({"id": own_ids[doc[go]], "n": pa.array(n[doc[go]], pa.int32()), "token": token[go].view(np.int64), "pos": pa.array(pos[go], pa.int32()), "sketch": pa.nulls(k, pa.binary())}))
        return pa.concat_tables(out)

    k = max(staged.n, 1)
    return sets.select("part", "ord", "id").repartition(k, "part").groupBy("part").cogroup(counts.repartition(k, "part").groupBy("part")).applyInArrow(part, TOKENS)


def _across(percent: int):
    """Of whole lists, by key and n: all pairs between different components that pass the filters, block by block."""

    def meet(left, right, lo, hi, apart: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of left with those of right from lo to hi; apart: of lists that hold two blocks, only pairs between them."""
        total = np.concatenate([[0], np.cumsum(np.maximum(hi - lo, 0))])
        i = 0
        while i < len(lo):
            j = max(i + 1, int(np.searchsorted(total, total[i] + (1 << 20), side="right")) - 1)
            partners = np.diff(total[i : j + 1])
            x = np.repeat(np.arange(i, j), partners)
            y = np.repeat(lo[i:j], partners) + _starts(partners)
            ok = (left["c"][x] != right["c"][y]) & (~apart[x] | (left["own"][x] != right["own"][y])) & may_link(left["n"][x], right["n"][y], left["pos"][x], right["pos"][y], percent)
            a, b = left["id"][x[ok]], right["id"][y[ok]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((high, low))  # a pair shares many elements: those met in this block go once
            low, high = low[order], high[order]
            own = np.ones(len(low), dtype=bool)
            own[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(low[own]), pa.array(high[own])], names=["a", "b"])
            i = j

    def lists(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        changed = np.zeros(len(x["token"]), dtype=bool)
        for name in ("token", "i", "j"):
            changed[1:] |= x[name][1:] != x[name][:-1]
        x["list"] = np.cumsum(changed)
        # the largest component of each list
        order = np.lexsort((x["c"], x["list"]))
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(x["c"][order]) != 0) | (np.diff(x["list"][order]) != 0)]))
        many, of = np.diff(np.append(begin, len(order))), x["list"][order[begin]]
        best = np.lexsort((many, of))[np.append(np.flatnonzero(np.diff(np.sort(of))), len(of) - 1)]
        large = np.zeros(int(x["list"][-1]) + 1, dtype=np.int64)
        large[of[best]] = x["c"][order[begin[best]]]
        big = x["c"] == large[x["list"]]
        rest, big = ({k: v[m] for k, v in x.items()} for m in (~big, big))
        here, there = (y["list"] * _WIDE + y["n"] for y in (rest, big))
        apart = rest["i"] != rest["j"]
        most, least = 100 * rest["n"] // percent, -(-percent * rest["n"] // 100)
        yield from meet(rest, rest, np.arange(len(here)) + 1, np.searchsorted(here, rest["list"] * _WIDE + most, side="right"), apart)
        yield from meet(rest, big, np.searchsorted(there, rest["list"] * _WIDE + least), np.searchsorted(there, rest["list"] * _WIDE + most, side="right"), apart)

    names = ("token", "i", "j", "own", "id", "n", "pos", "c")

    def run(batches):
        held: list[dict[str, np.ndarray]] = []
        whole = lambda: lists({k: np.concatenate([h[k] for h in held]) for k in names})
        for t in batches:
            x = {k: t.column(k).to_numpy() for k in names}
            if not len(x["n"]):
                continue
            x["n"], x["pos"] = x["n"].astype(np.int64), x["pos"].astype(np.int64)
            if held and any(held[-1][k][-1] != x[k][0] for k in names[:3]):
                yield from whole()
                held = []
            cut = int(np.logical_or.reduce([x[k] != x[k][-1] for k in names[:3]]).sum())  # rows before the last list
            if cut:
                held.append({k: v[:cut] for k, v in x.items()})
                yield from whole()
                held = []
            held.append({k: v[cut:] for k, v in x.items()})
        if held:
            yield from whole()

    return run


def jaccard_join(docs: DataFrame, size: int = 4, percent: int = 85, n_buckets: int | None = None, folder: str = "") -> Join:
    """folder: where all of it is, the result too."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "jaccard")
    staged = stage(docs, folder)
    n_buckets = n_buckets or bucket_count(staged.bytes, BUCKET_BYTES)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def describe(part: str) -> Iterator[pa.RecordBatch]:
        t = staged.read(part, ["doc_id", "text"])
        sig = pa.array([digest_of_words(x) for x in t["text"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([part] * t.num_rows, pa.string()), pa.array(np.arange(t.num_rows), pa.int32()), t["doc_id"].combine_chunks().cast(pa.int64()), sig], names=["part", "ord", "doc_id", "sig"])

    meta = keep(staged.each(describe, META), "meta")
    sets = keep(meta.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("part", "ord")).alias("x")).select(F.monotonically_increasing_id().alias("id"), "sig", "doc_id", "x.part", "x.ord"), "sets")
    found_tokens = keep(_prefixes(staged, sets, _counts(staged, sets, size, n_buckets), size, percent), "tokens")
    free_shuffles(staged)
    sets = keep(sets.join(found_tokens.where("sketch is not null").select("id", "n", "sketch"), "id"), "known")
    lists = found_tokens.where("token is not null").select("token", "id", "n", "pos")

    def compared(pairs: DataFrame, step: str) -> DataFrame:
        """Of distinct pairs (a, b) of sets, those that link: b's words travel to a's part."""
        side = lambda x: sets.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("part", "ord", "n", "sketch")))
        sides = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "part_a", "ord_a", "part_b", "ord_b", "n_a", "sketch_a", "n_b", "sketch_b")
        pairs = keep(sides.mapInArrow(_bounded(percent), PAIRS), f"{step}-pairs")
        chunks = pairs.groupBy("part_a").agg(F.ceil(F.count("*") / CHUNK).alias("k"))
        pairs = pairs.join(chunks, "part_a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("k")).cast("int"))

        def words(batches):
            """The texts that are wanted, part after part."""
            part, text = None, None
            for t in batches:
                at, want = 0, t.column("part_b").to_pylist()
                while at < len(want):
                    end = next((k for k in range(at, len(want)) if want[k] != want[at]), len(want))
                    if want[at] != part:
                        part, text = want[at], staged.read(want[at], ["text"])["text"].combine_chunks().cast(pa.binary())
                    for k in range(at, end, 500):
                        x = t.slice(k, min(500, end - k))
                        yield pa.RecordBatch.from_arrays([x.column("part_a"), x.column("chunk"), x.column("b"), text.take(x.column("ord_b"))], names=["part_a", "chunk", "b", "words"])
                    at = end

        def compare(own: pa.Table, there: pa.Table) -> pa.Table:
            if not own.num_rows:
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            ords, a = np.unique(own["ord_a"].to_numpy(), return_inverse=True)
            text = staged.read(own["part_a"][0].as_py(), ["text"])["text"].combine_chunks().cast(pa.binary()).take(pa.array(ords))
            known = exact_sets([*text.to_pylist(), *there["words"].to_pylist()], size)
            b = {x: len(ords) + k for k, x in enumerate(there["b"].to_pylist())}
            ok = [linked(known[i], known[b[j]], percent) for i, j in zip(a.tolist(), own["b"].to_pylist())]
            return own.select(["a", "b"]).filter(pa.array(ok))

        k = max(staged.n, 1)
        wanted = pairs.select("part_a", "chunk", "b", "part_b", "ord_b").distinct().repartition(k, "part_b").sortWithinPartitions("part_b", "ord_b")
        there = wanted.mapInArrow(words, "part_a string, chunk int, b long, words binary")
        links = keep(pairs.repartition(2 * k, "part_a", "chunk").groupBy("part_a", "chunk").cogroup(there.repartition(2 * k, "part_a", "chunk").groupBy("part_a", "chunk")).applyInArrow(compare, "a long, b long"), f"{step}-links")
        free_shuffles(staged)
        return links

    leader = lists.groupBy("token").agg(F.min(F.struct("pos", "id", "n")).alias("x"), F.count("*").alias("many")).where("many > 1").select("token", F.col("x.id").alias("b"), F.col("x.n").alias("m"), F.col("x.pos").alias("q"), "many")
    near = lists.join(leader, "token").where("id <> b").where((100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("q")) * (100 + percent) >= percent * (F.col("n") + F.col("m"))))
    first = keep(near.select(F.col("id").alias("a"), "b").distinct(), "first")
    found = keep(components(compared(first, "leaders")), "found")

    named = lists.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    mixed = named.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("many")).where("low < high").select("token", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks"))
    rest = named.join(mixed, "token").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    dealt = rest.select("token", "own", "id", "n", "pos", "c", F.explode(meets).alias("x")).select("token", "x.i", "x.j", "own", "id", "n", "pos", "c")
    whole = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n")
    pairs = whole.mapInArrow(_across(percent), "a long, b long").distinct().join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = compared(pairs, "across")
    ends = more.join(found.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("component").alias("y")), "b", "left")
    merged = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    label = sets.select("id", "sig", "doc_id", "n").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    label = keep(label.join(merged.withColumnRenamed("node", "c"), "c", "left").select("sig", "doc_id", "n", F.coalesce("component", "c").alias("component")), "label")
    smallest = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = label.select("sig", "n", "component").join(smallest, "component")
    filled = meta.where("sig is not null").join(of_set, "sig").select("part", "ord", "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "component", F.col("sig").alias("key"))
    bare = meta.where("sig is null").select("part", "ord", "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"), F.col("sig").alias("key"))
    result = keep(filled.unionByName(bare), "result")
    for name in ("meta", "sets", "tokens", "known", "first", "found", "label", *(f"{k}-{x}" for k in ("leaders", "across") for x in ("pairs", "links"))):
        remove(f"{folder}/{name}")
    free_shuffles(staged)
    return Join(staged, result, docs.schema)
