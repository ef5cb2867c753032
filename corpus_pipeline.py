"""The corpus pipeline: quality rules, n-gram Jaccard join, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the
last return the columns of documents.  run() writes each stage's rows as Parquet in the shared
folder and reads them again as the next one's documents; a table that is read no more goes.

All stages: null text counts as empty (the first stage rejects it); null and repeated doc_ids
are rows of their own; repeated rows are near-duplicates of one another, of which one stays; ties
are broken as the operators say; texts of any length are whole; an empty table gives an empty
table.  Further columns, whatever their names, pass unchanged through all stages but the last,
which returns its own alone.

A stage that is called alone returns a table of its own and drops the folder it worked in; run()
hands each stage a folder and drops it once the rows are written.  Calls share nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaquery.llm import cascade, jaccard_join, packing, substring
from vistaquery.llm.queries import END_ID, SEQUENCE, table, tokenizer_path
from vistaquery.llm.work import remove, work_dir

#: Holds a document's further columns while an operator, which adds columns of its own, has it.
CARRIED = "carried_columns"


def _bare(docs: DataFrame) -> DataFrame:
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias(CARRIED)] if others else []))


def _dressed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col(CARRIED).getField(c).alias(c) for c in docs.columns))


def _in_folder(spark: SparkSession, folder: str | None, label: str, make: Callable[[str], DataFrame]) -> DataFrame:
    """make(a folder that its rows may be read from)."""
    if folder:
        return make(folder)
    own, out = work_dir(spark, label), f"{work_dir(spark, f'{label}-rows')}/rows"
    rows = make(own)
    rows.write.parquet(out)
    remove(own)
    return spark.read.schema(rows.schema).parquet(out)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Drops the documents that a quality rule rejects."""
    return _dressed(cascade.judge(_bare(docs)).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group: five words, a similarity of 0.8."""
    return _in_folder(spark, folder, "join", lambda own: _dressed(jaccard_join.jaccard_join(_bare(docs), size=5, percent=80, folder=own).representatives(), docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Removes words of passages of 50 words or more that start earlier; n_chars follows, and
    documents of which nothing is left go."""

    def make(own: str) -> DataFrame:
        rows = substring.dedup_substrings(_bare(docs), size=PASSAGE, joined=False, folder=own).where("n_removed = 0 or n_removed < n_words")
        if "n_chars" in docs.columns:
            shorter = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(CARRIED)["n_chars"]).cast(docs.schema["n_chars"].dataType)
            rows = rows.withColumn(CARRIED, F.col(CARRIED).withField("n_chars", shorter))
        return _dressed(rows, docs)

    return _in_folder(spark, folder, "substring", make)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Packs what is left into sequences of SEQUENCE tokens: doc_id, piece, start, length, sequence_id, offset and the ids' crc32."""

    def make(own: str) -> DataFrame:
        pieces = packing.token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), END_ID, SEQUENCE, own, REMEMBER)
        return packing.pack_lengths(pieces.drop("tokens"), SEQUENCE, folder=own).drop("piece_key")

    return _in_folder(spark, folder, "packing", make)


#: Words that a worker's encoder remembers here, fewer than alone, as other stages' memory is still there.
REMEMBER = 300_000
#: Words of a passage that the third stage takes for repeated.
PASSAGE = 50
STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("best-fit packing", sequences)]
#: SQL can't express the stages from the second on; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = work_dir(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        own = work_dir(spark, f"stage{k}")
        stage(spark, docs, sf_dir, own).write.parquet(f"{folder}/{k}")
        remove(own)
        if k:  # its rows are in the next table
            remove(f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
