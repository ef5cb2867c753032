"""Embedding near-dedup by a forest of random-projection trees with spill.

Equal vectors count as one, with their number.  Every tree splits by the median of a random
projection, again and again; vectors within a margin of a split go to both sides, so a close
pair is parted only where its projections differ by more than two margins.  The splits are
fitted on a bounded sample (SAMPLE vectors at most), every vector is routed through them, and
one tree after the other a task compares all vectors of each leaf.  A leaf that is too large
for a task is dealt to blocks, and each two blocks meet in a task of their own, so none is left
out.  A product in single precision finds the pairs that are surely above the threshold and
those near it, which dot products and norms in double precision decide.

No pairs leave a task.  A vector carries the leaves of earlier trees, so that each pair is
counted in the first leaf in which it meets and links add up; and a leaf returns for each
vector the smallest one that it reaches there, from which the components follow.

Null vectors, zero ones and those that hold null or non-finite components link with nothing.
Vectors of different lengths never link.  Null vec_id: never the smallest of others; alone,
its component is null.  Repeated vec_ids: each row is a vector.  Ties: a cosine that equals the
threshold links.  Empty table: no rows.  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .work import free_now, remove, work_dir

TREES, LEAF, BLOCK, SAMPLE, ROWS = 4, 8192, 16384, 20000, 1024
#: Vectors for each of the four leaves that smaller tables are split into.
SMALL = 64
#: The margin in standard deviations of the projected difference of two vectors at the threshold.
SPILL = 0.5
#: Levels whose thresholds differ by node; deeper ones differ by the node's ancestor at this level.
NODE_LEVELS = 9
#: What products of unit vectors in single precision may be off by.
ROUNDING = 1e-5


def direction(tree: int, level: int, dim: int) -> np.ndarray:
    x = np.random.Generator(np.random.PCG64([tree, level, dim])).standard_normal(dim)
    return x / np.linalg.norm(x)


def depth_of(n: int) -> int:
    """Levels of a tree of n vectors: leaves hold about LEAF of them, and tables of 4 * SMALL and more are split twice at least."""
    return max(math.ceil(math.log2(n / LEAF)), min(2, int(math.log2(n / SMALL)))) if n > SMALL else 0


def margin(dim: int, threshold: float) -> float:
    return SPILL * math.sqrt(max(2 * (1 - threshold), 0) / dim)


def _divide(p: np.ndarray, node: np.ndarray, at: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    """Which entries go left and which go right of their node's threshold."""
    return p < at[node] + m, p >= at[node] - m


class Tree:
    def __init__(self, tree: int, sample: np.ndarray, depth: int, threshold: float) -> None:
        self.tree, self.dim, self.depth = tree, sample.shape[1], depth
        self.margin, self.at = margin(self.dim, threshold), []
        node = np.zeros(len(sample), dtype=np.int64)
        for level in range(depth):
            p = sample @ direction(tree, level, self.dim)
            own = node >> max(0, level - NODE_LEVELS)
            at = np.full(1 << min(level, NODE_LEVELS), float(np.median(p)) if len(p) else 0.0)
            order = np.argsort(own, kind="stable")
            cut = np.searchsorted(own[order], np.arange(len(at) + 1))
            for k in np.flatnonzero(np.diff(cut) >= 16):
                at[k] = np.median(p[order[cut[k] : cut[k + 1]]])
            self.at.append(at)
            node = 2 * node + (p >= at[own])

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row belongs to, in order of row and leaf."""
        row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for level in range(self.depth):
            p = (x @ direction(self.tree, level, self.dim))[row]
            left, right = _divide(p, node >> max(0, level - NODE_LEVELS), self.at[level], self.margin)
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        order = np.lexsort((node, row))
        return row[order], node[order]


def near_in_leaf(x: np.ndarray, threshold: float, homes: list[bytes], weights: np.ndarray, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of all vectors of a leaf (block: only pairs of two blocks): the first row that each reaches, and its links to others that did not meet before."""
    n = len(x)
    unit = _unit(x.astype(np.float64))
    single = unit.astype(np.float32)
    near, links = np.zeros((n, n), dtype=bool), np.zeros(n, dtype=np.int64)
    before = [np.frombuffer(h, dtype=np.int64) for h in homes]
    _, at = np.unique(np.concatenate(before), return_inverse=True)
    of = np.repeat(np.arange(n), [len(h) for h in before])
    for i in range(0, n, ROWS):
        j = min(i + ROWS, n)
        product = single[i:j] @ single.T
        close = product >= threshold - ROUNDING
        a, b = np.nonzero(close & (product < threshold + ROUNDING))
        for k in range(0, len(a), 1 << 16):
            s = slice(k, k + (1 << 16))
            close[a[s], b[s]] = _cosine(x[i + a[s]].astype(np.float64), x[b[s]].astype(np.float64)) >= threshold
        close[np.arange(j - i), np.arange(i, j)] = False
        if block is not None:
            close &= block[i:j, None] != block[None, :]
        near[i:j] = close
    some = np.flatnonzero(near.any(1))
    if len(some):
        inside = np.full(n, -1)
        inside[some] = np.arange(len(some))
        met = np.zeros((len(some), int(at.max()) + 1 if len(at) else 1), dtype=np.float32)
        keep = inside[of] >= 0
        met[inside[of[keep]], at[keep]] = 1
        met = met[:, met.sum(0) > 1]
        for i in range(0, len(some), ROWS):
            new = near[np.ix_(some[i : i + ROWS], some)] & (met[i : i + ROWS] @ met.T == 0)
            links[some[i : i + ROWS]] = new @ weights[some]
    root = np.arange(n)
    while len(some):
        low = np.minimum(root[some], np.concatenate([np.where(near[np.ix_(some[i : i + ROWS], some)], root[some], n).min(1) for i in range(0, len(some), ROWS)]))
        low = np.minimum(low, root[low])
        if (low == root[some]).all():
            break
        root[some] = low
    return root, links


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _read(kind: str, with_id: bool):
    """sig (128 bits of the components; null if the vector links with nothing), and vec_id, or length and components."""
    wide = np.dtype(kind).itemsize

    def run(batches):
        for b in batches:
            column = b.column(1)
            length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)  # null: not a number; -0.0: 0.0
            end = np.cumsum(length)
            total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[np.concatenate([[0], end])])
            ok = (length > 0) & (total(~np.isfinite(values)) == 0) & (total(values != 0) > 0)
            raw = memoryview(values.tobytes())
            blob = [bytes(raw[wide * (e - n) : wide * e]) if o else None for e, n, o in zip(end.tolist(), length.tolist(), ok.tolist())]
            sig = pa.array([None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in blob], pa.binary())
            if with_id:
                yield pa.RecordBatch.from_arrays([b.column(0), sig], names=["vec_id", "sig"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), sig, pa.array(length, pa.int32()), pa.array(blob, pa.binary())], names=["vec_id", "sig", "dim", "vector"])

    return run


ROUTED = "dim int, leaf long, id long, copies long, homes binary, vector binary"


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, trees: int = TREES) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    folder = work_dir(spark, "forest")
    single = isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "f4" if single else "f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    read = rows.mapInArrow(_read(kind, False), "vec_id long, sig binary, dim int, vector binary").where("sig is not null")
    distinct = keep(read.groupBy("sig").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vector").alias("vector")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    free_now(spark)

    sizes = {r.dim: r.n for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per length of vectors
    total = sum(sizes.values())
    sample = distinct.select("dim", "vector").sample(min(1.0, 1.2 * SAMPLE / max(total, 1)), seed=4).limit(SAMPLE).collect()
    forest = {}
    for dim, n in sizes.items():
        own = [r.vector for r in sample if r.dim == dim]
        x = _unit(_vectors(own, kind).astype(np.float64)) if own else np.zeros((0, dim))
        forest[dim] = [Tree(t, x, depth_of(n), threshold) for t in range(trees if depth_of(n) else 1)]
    shared = spark.sparkContext.broadcast(forest)  # fitted on SAMPLE vectors: 2**NODE_LEVELS thresholds a level at most

    def routes(last: int, dim: int, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [t.route(x) for t in shared.value[dim][: last + 1]]

    def batches_of(batches, columns: int):
        for b in batches:
            dims = b.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                yield dim, [b.column(k).take(pa.array(own)) for k in range(columns)]

    def sized(tree: int):
        def run(batches):
            for dim, (_, blob) in batches_of(batches, 2):
                if tree < len(shared.value[dim]):
                    leaf, n = np.unique(shared.value[dim][tree].route(_unit(_vectors(blob.to_pylist(), kind).astype(np.float64)))[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), dim), pa.int32()), pa.array(leaf), pa.array(n)], names=["dim", "leaf", "n"])

        return run

    def route(tree: int):
        def run(batches):
            for dim, (_, blob, ids, copies) in batches_of(batches, 4):
                if tree >= len(shared.value[dim]):
                    continue
                found = routes(tree, dim, _unit(_vectors(blob.to_pylist(), kind).astype(np.float64)))
                row, leaf = found[-1]
                earlier = [np.concatenate([x[k] for x in found[:-1]] or [np.zeros(0, np.int64)]) for k in (0, 1)]
                home = np.concatenate([leaf * trees + t for t, (_, leaf) in enumerate(found[:-1])] or [np.zeros(0, np.int64)])
                order = np.argsort(earlier[0], kind="stable")
                home, cut = home[order], np.searchsorted(earlier[0][order], np.arange(len(blob) + 1))
                begin = np.searchsorted(row, row)  # this tree's leaves of the row, of which those before this one count too
                for i in range(0, len(row), 8192):
                    k = np.arange(i, min(i + 8192, len(row)))
                    r = pa.array(row[k])
                    homes = [np.concatenate([home[cut[q] : cut[q + 1]], leaf[b0:e] * trees + tree]).tobytes() for q, b0, e in zip(row[k].tolist(), begin[k].tolist(), k.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), dim), pa.int32()), pa.array(leaf[k]), ids.take(r), copies.take(r), pa.array(homes, pa.binary()), blob.take(r)], names=["dim", "leaf", "id", "copies", "homes", "vector"])

        return run

    def compare(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        ids = t["id"].to_numpy()
        root, links = near_in_leaf(_vectors(t["vector"].to_pylist(), kind), threshold, t["homes"].to_pylist(), t["copies"].to_numpy(), t["own"].to_numpy() if i != j else None)
        some = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pa.table({"id": ids[some], "root": ids[root[some]], "links": links[some]})

    found = None
    for tree in range(max([len(x) for x in forest.values()], default=0)):
        large = distinct.select("dim", "vector").mapInArrow(sized(tree), "dim int, leaf long, n long").groupBy("dim", "leaf").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK).select("dim", "leaf", F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("blocks"))
        large = keep(large, f"large{tree}")
        routed = distinct.select("dim", "vector", "id", "copies").mapInArrow(route(tree), ROUTED)
        blocks = F.coalesce("blocks", F.lit(1))
        dealt = routed.join(F.broadcast(large), ["dim", "leaf"], "left") if large.count() < 10_000 else routed.join(large, ["dim", "leaf"], "left")
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
        dealt = dealt.withColumn("m", F.explode(meets)).select("dim", "leaf", "m.i", "m.j", "own", "id", "copies", "homes", "vector")
        links = keep(dealt.groupBy("dim", "leaf", "i", "j").applyInArrow(compare, "id long, root long, links long"), f"links{tree}")
        found = links if found is None else found.unionByName(links)
        free_now(spark)
    bare = rows.mapInArrow(_read(kind, True), "vec_id long, sig binary")
    if found is None:
        return bare.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    label = distinct.select("id", "sig", "first", "copies").join(components(found.select("id", "root").where("id <> root")).withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    partners = found.groupBy("id").agg(F.sum("links").alias("partners"))
    label = keep(label.join(partners, "id", "left").select("sig", "first", "c", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links")), "label")
    smallest = label.groupBy("c").agg(F.min("first").alias("component_id"))
    known = label.join(smallest, "c").select("sig", "n_links", "component_id", F.lit(True).alias("linked"))
    for name in ("distinct", *(f"links{t}" for t in range(trees))):
        remove(f"{folder}/{name}")
    out = bare.join(known, "sig", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _vectors(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=kind).reshape(len(blobs), -1)


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows, in double precision."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
