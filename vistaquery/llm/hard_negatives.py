"""Hard-negative mining by blocked products of anchors and all rows.

Vectors are scaled, floored and staged as parts of a set size in double precision, the anchors
among them as smaller blocks.  A task takes one anchor block and a group of parts and multiplies
them block by block, keeping for each anchor the best rows that it has seen; what the tasks of a
block return is merged by a window.  The first pass finds each anchor's best rows of the same
label, its positives; the second one, for each positive, the best rows of other labels whose score
is within a window below the positive's.  Each block of anchors meets every part once a pass, and
a task returns a set number of rows for each anchor, whatever the number of rows it has read.

Scores are integers, exact while they and the products' sums of squares are below 2**53 (floored
values below 2**26 in length); beyond that they are rounded as doubles are, and end at the bounds of
a long.  Rows take no part whose label or vector is null, or that hold null or non-finite
components, scaled ones too.  Vectors of different lengths are not compared.  Ties: the smaller
vec_id, null (told by the largest long) last.  Repeated vec_ids and rows: each row is an anchor,
a positive and a negative of its own, and only the anchor's own row is not its positive.  Empty
table, no anchors or no row within a window: no rows.  Further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import give_back, stage, work_dir

#: Bytes of a block of anchors, groups of parts that a block's tasks share, rows and columns of one product.
ANCHOR_BYTES, GROUPS, ROWS, COLUMNS = 1 << 20, 1024, 256, 2048
NULL_ID = np.iinfo(np.int64).max
_ROWS = "vec_id long, label long, dim int, anchor boolean, vector binary"


class Best:
    """The k best (score, id) of each of n rows so far: scores fall, and equal ones' ids rise."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), NULL_ID)

    def add(self, rows: slice, score: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """score: of the rows and ids; ok: which of them count."""
        held, known = self.score[rows], self.id[rows]
        hit = ok & (score >= held[:, -1:])
        many = np.flatnonzero(hit.sum(1) > self.k)
        if len(many):
            own = np.where(hit[many], score[many], -np.inf)
            hit[many] &= own >= np.partition(own, own.shape[1] - self.k, axis=1)[:, own.shape[1] - self.k, None]
        row, column = np.nonzero(hit)
        if not len(row):
            return
        some = np.unique(row)
        old, place = np.nonzero(np.isfinite(held[some]))
        every = np.concatenate([some[old], row])
        value = np.concatenate([held[some[old], place], score[row, column]])
        name = np.concatenate([known[some[old], place], ids[column]])
        order = np.lexsort((name, -value, every))
        every, value, name = every[order], value[order], name[order]
        rank = np.arange(len(every)) - np.searchsorted(every, every)
        top = rank < self.k
        held[every[top], rank[top]], known[every[top], rank[top]] = value[top], name[top]


def _read(scale: float):
    def run(batches):
        for b in batches:
            column = b.column(2)
            length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                value = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            end = np.cumsum(np.maximum(length, 0))
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
            ok = np.flatnonzero((length >= 0) & (bad[end] == bad[end - np.maximum(length, 0)]))
            blobs = [value[e - n : e].tobytes() for e, n in zip(end[ok].tolist(), length[ok].tolist())]
            taken = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), pa.array(length[ok].astype(np.int32)), b.column(3).take(taken), pa.array(blobs, pa.binary())], names=["vec_id", "label", "dim", "anchor", "vector"])

    return run


class Block:
    """The rows of a part that have one length."""

    def __init__(self, t: pa.Table) -> None:
        self.id = pc.fill_null(t["vec_id"], NULL_ID).to_numpy()
        self.label, self.row = t["label"].to_numpy(), t["row"].to_numpy()
        self.x = np.frombuffer(b"".join(t["vector"].to_pylist()), dtype=np.float64).reshape(t.num_rows, -1)

    def __len__(self) -> int:
        return len(self.id)


def _blocks(t: pa.Table) -> dict[int, Block]:
    return {d: Block(t.filter(pc.equal(t["dim"], d))) for d in pc.unique(t["dim"]).to_pylist()}


def _products(anchors: Block, other: Block):
    """(rows, columns, scores) of all products, some at a time."""
    for i in range(0, len(anchors), ROWS):
        for j in range(0, len(other), COLUMNS):
            rows, columns = slice(i, i + ROWS), slice(j, j + COLUMNS)
            yield rows, columns, anchors.x[rows] @ other.x[columns].T


def _whole(x: np.ndarray) -> np.ndarray:
    """Scores as longs."""
    return np.where(x >= 2.0**63, NULL_ID, np.where(x < -(2.0**63), np.iinfo(np.int64).min, np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64)))


def mine(vectors: DataFrame, anchor: Column, scale: float = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, folder: str | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for rows of vectors (vec_id, label, embedding).

    anchor: which rows are anchors.  A negative's score is low to high percent of the positive's."""
    spark = vectors.sparkSession
    folder = folder or work_dir(spark, "negatives")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    read = rows.where("label is not null and embedding is not null").mapInArrow(_read(float(scale)), _ROWS).withColumn("row", F.monotonically_increasing_id())
    parts = stage(read, folder, "rows", ["vec_id"])

    def anchors_of(part: str):
        t = parts.read(part)
        yield from t.filter(t["anchor"]).to_batches()

    found = parts.each(anchors_of, f"{_ROWS}, row long")
    anchors = stage(found, folder, "anchors", limit=ANCHOR_BYTES)
    groups = max(1, min(parts.n, GROUPS))
    grouped = parts.parts().groupBy(F.pmod(F.xxhash64("part"), F.lit(groups)).alias("g")).agg(F.collect_list("part").alias("parts"))
    tasks = anchors.parts().select(F.col("part").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g")).join(grouped, "g")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(max(1, min(anchors.n * groups, 1 << 16)), "block", "g")

    def nearest(batches):
        for block, names in ((b, p) for t in batches for b, p in zip(t.column("block").to_pylist(), t.column("parts").to_pylist())):
            own = _blocks(anchors.read(block))
            best = {d: Best(len(a), positives) for d, a in own.items()}
            for part in names:
                for d, other in _blocks(parts.read(part)).items():
                    a = own.get(d)
                    for i, j, score in _products(a, other) if a else ():
                        ok = (a.label[i, None] == other.label[None, j]) & (a.row[i, None] != other.row[None, j])
                        best[d].add(i, score, other.id[j], ok)
            for d, a in own.items():
                r, k = np.nonzero(np.isfinite(best[d].score))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(r), pa.string()), pa.array(a.row[r]), pa.array(best[d].score[r, k]), pa.array(best[d].id[r, k])], names=["block", "row", "score", "id"])
            give_back()

    first = dealt(tasks).mapInArrow(nearest, "block string, row long, score double, id long")
    ranked = first.withColumn("k", F.expr("row_number() over (partition by block, row order by score desc, id)")).where(F.col("k") <= positives)
    ranked.groupBy("block").agg(F.collect_list(F.struct("row", "k", "score", "id")).alias("known")).write.parquet(f"{folder}/positives")
    known = spark.read.parquet(f"{folder}/positives")

    def hardest(batches):
        for block, names, found in ((b, p, k) for t in batches for b, p, k in zip(t.column("block").to_pylist(), t.column("parts").to_pylist(), t.column("known"))):
            flat = pa.table(dict(zip(("row", "k", "score", "id"), found.values.flatten())))
            own, state = _blocks(anchors.read(block)), {}
            for d, a in own.items():
                place = {r: i for i, r in enumerate(a.row.tolist())}
                score, ident = np.full((len(a), positives), np.nan), np.full((len(a), positives), NULL_ID)
                for r, k, s, x in zip(*(flat[c].to_pylist() for c in ("row", "k", "score", "id"))):
                    if r in place:
                        score[place[r], k - 1], ident[place[r], k - 1] = s, x
                with np.errstate(invalid="ignore"):
                    least, most = _percent(score, low, up=True), _percent(score, high, up=False)
                state[d] = score, ident, least, most, [Best(len(a), negatives) for _ in range(positives)]
            for part in names:
                for d, other in _blocks(parts.read(part)).items():
                    a = own.get(d)
                    for i, j, score in _products(a, other) if a else ():
                        differs = a.label[i, None] != other.label[None, j]
                        for k, best in enumerate(state[d][4]):
                            best.add(i, score, other.id[j], differs & (score >= state[d][2][i, k, None]) & (score <= state[d][3][i, k, None]))
            for d, a in own.items():
                score, ident, _, _, tops = state[d]
                for k, best in enumerate(tops):
                    r, q = np.nonzero(np.isfinite(best.score))
                    longs = a.row[r], np.full(len(r), k), a.id[r], ident[r, k], _whole(score[r, k]), best.id[r, q], _whole(best.score[r, q])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in longs], names=_FOUND)
            give_back()

    again = dealt(tasks.join(known, "block")).mapInArrow(hardest, ", ".join(f"{x} long" for x in _FOUND))
    order = "row_number() over (partition by row, k order by negative_score desc, negative_id)"
    out = again.withColumn("rank", F.expr(order)).where(F.col("rank") <= negatives)
    ident = lambda c: F.nullif(F.col(c), F.lit(int(NULL_ID))).alias(c)
    return out.select(ident("anchor_id"), ident("positive_id"), "rank", ident("negative_id"), "positive_score", "negative_score")


_FOUND = ["row", "k", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]


def _percent(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """The least (up) or largest whole number at or beyond percent of whole scores; no positive: NaN, which nothing reaches."""
    out = np.full(score.shape, np.nan)
    for at in zip(*np.nonzero(np.isfinite(score))):
        whole = int(score[at]) * percent
        out[at] = -(-whole // 100) if up else whole // 100
    return out
