"""Merkle manifest of a table, in an external-memory node store.

A leaf is the digest of a row's fields.  Leaves of a tree (documents of one language) are sorted
into runs by range partitions and numbered by run, count and offset, so no task ever holds a
whole tree.  The runs are level 0 of the store; each further level is written by reading the one
before it in order and digesting every ARITY consecutive nodes, until each tree has one node, its
subroot.  The subroots, in order of their language, are the leaves of the top tree.  A node's
coordinate is (level, tree, pos).  Proofs are made from the top down: the runs of a level and the
paths of their parents are merged by coordinate, so that a level's paths are written once for
ARITY nodes below, and the leaves' own are streamed.

Null fields count as such (an empty text is another value).  Null lang: a tree of its own, before
the others.  Null doc_id: before other leaves of its tree; such and repeated doc_ids ascend by
leaf, and equal rows are leaves of their own.  Texts of any length are whole.  Empty table: no
nodes, no rows.  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import remove, work_dir

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, pos long, size long, node binary"
_PATH = "array<struct<at:int,siblings:array<binary>>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields, in lower-case hex; changed: fields that have another value."""
    return F.sha2(F.concat(*(field(changed.get(f, F.col(f))) for f in FIELDS)), 256)


def _hex(node: Column) -> Column:
    return F.lower(F.hex(node))


def _merge(a: DataFrame, b: DataFrame, *names: str) -> DataFrame:
    """a joined with b by columns that may be null."""
    b = b.withColumnsRenamed({n: f"other_{n}" for n in names})
    return a.join(b, [F.col(n).eqNullSafe(F.col(f"other_{n}")) for n in names]).drop(*(f"other_{n}" for n in names))


@dataclass(frozen=True)
class Manifest:
    """The node store: trees/level=k and top/level=k in folder hold (tree, pos, size, node), size being the number of nodes that the tree has on the level."""

    spark: SparkSession
    folder: str
    levels: int
    top_levels: int
    carried: str  # the DDL of what level 0 holds beside the nodes

    def level(self, kind: str, k: int) -> DataFrame:
        more = "" if k else f", {self.carried}" if kind == "trees" else ", lang string"
        return self.spark.read.schema(_NODE + more).parquet(f"{self.folder}/{kind}/level={k}")

    def root(self) -> DataFrame:
        """One row with the root; no row if the table is empty."""
        return self.level("top", self.top_levels - 1).where("size = 1").select(_hex(F.col("node")).alias("root"))

    def subroots(self) -> DataFrame:
        """lang and subroot."""
        return self.level("top", 0).select("lang", _hex(F.col("node")).alias("subroot"))

    def proofs(self) -> DataFrame:
        """A row for each leaf: lang, pos, leaf, what it carries, subroot, root, and proof: for each level from the
        leaf's own to the root's, at (the place among the run) and siblings (the run's others), digests in hex."""
        if not self.levels:
            return self.spark.createDataFrame([], f"lang string, pos long, leaf string, {self.carried}, subroot string, root string, proof array<struct<at:int,siblings:array<string>>>")
        start = self.level("top", self.top_levels - 1).where("size = 1").select("tree", F.col("node").alias("root"), F.array().cast(_PATH).alias("path"))
        top = self._descend("top", self.top_levels, start, ["root"], ["lang"])
        start = top.select(F.col("lang").alias("tree"), F.col("node").alias("subroot"), "root", "path")
        start.write.parquet(f"{self.folder}/subroot_paths")
        carried = [x.split()[0] for x in self.carried.split(", ")]
        rows = self._descend("trees", self.levels, self.spark.read.parquet(f"{self.folder}/subroot_paths"), ["subroot", "root"], carried, text=True)
        return rows.select(F.col("tree").alias("lang"), "pos", _hex(F.col("node")).alias("leaf"), *carried, _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), F.col("path").alias("proof"))

    def _descend(self, kind: str, levels: int, start: DataFrame, kept: list[str], carried: list[str], text: bool = False) -> DataFrame:
        """From the paths of the trees' roots (start) those of all nodes of level 0; text: digests of level 0's paths are hex."""
        above = None
        for k in reversed(range(levels)):
            level, more = self.level(kind, k), carried if k == 0 else []
            digest = _hex if text and k == 0 else lambda x: x
            shown = F.transform("path", lambda p: F.named_struct(F.lit("at"), p.at, F.lit("siblings"), F.transform(p.siblings, digest)))
            roots = level.where("size = 1")
            found = _merge(roots, start, "tree").select("tree", "pos", "node", *more, *kept, shown.alias("path"))
            if above is not None:
                runs = level.where("size > 1").groupBy("tree", F.expr(f"pos div {ARITY}").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("pos", "node", *more))).alias("run"))
                joined = _merge(runs, above.select("tree", F.col("pos").alias("parent"), *kept, "path"), "tree", "parent").select("tree", "run", *kept, shown.alias("path"))
                one = joined.select("tree", F.explode("run").alias("x"), F.transform("run", lambda y: F.named_struct(F.lit("pos"), y.pos, F.lit("node"), digest(y.node))).alias("run"), *kept, "path")
                others = F.transform(F.filter("run", lambda y: y.pos != F.col("x.pos")), lambda y: y.node)
                own = F.struct(F.expr(f"cast(x.pos % {ARITY} as int)").alias("at"), others.alias("siblings"))
                found = found.unionByName(one.select("tree", "x.pos", "x.node", *(f"x.{c}" for c in more), *kept, F.concat(F.array(own), "path").alias("path")))
            if k == 0:
                return found
            found.write.parquet(f"{self.folder}/{kind}_paths/level={k}")
            above = self.spark.read.parquet(f"{self.folder}/{kind}_paths/level={k}")
        raise AssertionError("no level")


def fold(first: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    join = lambda x, a, n: F.array_join(F.slice(x, a, n), "")
    return F.aggregate(proof, first, lambda node, p: F.sha2(F.concat(join(p.siblings, F.lit(1), p.at), node, join(p.siblings, p.at + 1, F.lit(ARITY))), 256))


def _numbered(rows: DataFrame, order: list[str], folder: str) -> DataFrame:
    """rows (tree, ...) with pos in their tree, by order, and size, the tree's number of rows.

    Rows are sorted into ranges of the whole order, equal ones dealt too; a range's place in a
    tree follows from the counts of the ranges before it, a row for each tree and range."""
    spark = rows.sparkSession
    rows.withColumn("salt", F.monotonically_increasing_id()).write.parquet(f"{folder}.digests")
    digests = spark.read.parquet(f"{folder}.digests")
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "salt")]
    digests.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt").withColumn("seq", F.monotonically_increasing_id()).write.parquet(f"{folder}.runs")
    remove(f"{folder}.digests")
    runs = spark.read.parquet(f"{folder}.runs").withColumn("run", F.shiftright("seq", 33))
    counts = runs.groupBy("tree", "run").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    counts = counts.select("tree", "run", "first", F.expr("sum(n) over (partition by tree order by run) - n").alias("before"), F.expr("sum(n) over (partition by tree)").alias("size"))
    return _merge(runs, counts, "tree", "run").select("tree", (F.col("before") + F.col("seq") - F.col("first")).alias("pos"), "size", *(c for c in rows.columns if c != "tree"))


def _grow(spark: SparkSession, folder: str, leaves: DataFrame) -> int:
    """Writes level 0 and all above it; returns the number of levels."""
    leaves.sortWithinPartitions("tree", "pos").write.parquet(f"{folder}/level=0")
    remove(f"{folder}.runs")
    size = spark.read.schema(_NODE).parquet(f"{folder}/level=0").agg(F.max("size")).first()[0]
    k = 0
    while size and size > 1:
        below = spark.read.schema(_NODE).parquet(f"{folder}/level={k}").where("size > 1")
        parent = below.select("tree", F.expr(f"pos div {ARITY}").alias("parent"), F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("above"), "pos", "node").repartitionByRange("tree", "parent")
        run = parent.groupBy("tree", F.col("parent").alias("at"), F.col("above").alias("size")).agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("run"))
        node = F.unhex(F.sha2(F.array_join(F.transform("run", lambda x: _hex(x.node)), ""), 256))
        run.select("tree", F.col("at").alias("pos"), "size", node.alias("node")).sortWithinPartitions("tree", "pos").write.parquet(f"{folder}/level={k + 1}")
        size, k = -(-size // ARITY), k + 1
    return k + 1 if size else 0


def write_manifest(docs: DataFrame, folder: str | None = None, **carried: Column) -> Manifest:
    """Writes the node store of docs; carried: columns that leaves carry beside doc_id."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "manifest")
    rows = docs.select(F.col("lang").cast("string").alias("tree"), F.unhex(leaf()).alias("node"), "doc_id", *(c.alias(n) for n, c in carried.items()))
    names = ["doc_id", *carried]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    levels = _grow(spark, f"{folder}/trees", _numbered(rows, ["doc_id", "node"], f"{folder}/trees"))
    if not levels:
        return Manifest(spark, folder, 0, 0, ddl)
    ends = [spark.read.schema(_NODE).parquet(f"{folder}/trees/level={k}").where("size = 1") for k in range(levels)]
    subroots = ends[0]
    for x in ends[1:]:
        subroots = subroots.unionByName(x)
    top = _numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "node"), ["lang"], f"{folder}/top")
    return Manifest(spark, folder, levels, _grow(spark, f"{folder}/top", top), ddl)
