"""An inverted index of collection documents: token to postings, in folders by the token's bucket.

A posting is a row (token, number of the document), so a token that all documents hold is many rows
and no large one; collection and id, which are much longer than the number, stand once a document.
A search names its tokens' buckets as literals, so the scan prunes all other
folders, and row groups by the token within them; the documents' token texts, which decide the
bonus for a phrase, are searched where they lie."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.query import QuerySpec
from ..sources.shared import new_folder

#: Folders of the postings.
BUCKETS = 256
_POSTING = "token string, doc long, bucket int"
_DOCUMENT = "doc long, collection string, entry_id string, token_string string, words array<string>"
PHRASE_BONUS = 2  #: fixed value: for documents that hold the query's whole text of tokens


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class LexicalIndex:
    spark: SparkSession
    folder: str
    buckets: int

    def postings(self) -> DataFrame:
        return self.spark.read.schema(_POSTING).parquet(f"{self.folder}/postings")

    def documents(self) -> DataFrame:
        return self.spark.read.schema(_DOCUMENT).parquet(f"{self.folder}/documents")

    def buckets_of(self, tokens: list[str]) -> list[int]:
        """Spark's own hash, of the queries' tokens alone."""
        rows = self.spark.createDataFrame([(t,) for t in tokens], "token string")
        return sorted({r[0] for r in rows.select(_bucket(F.col("token"), self.buckets)).collect()})

    def postings_of(self, tokens: list[str]) -> DataFrame:
        return self.postings().where(F.col("bucket").isin(self.buckets_of(tokens)) & F.col("token").isin(tokens))

    def candidates(self, queries: list[QuerySpec]) -> DataFrame:
        """collection, entry_id, query_id and score of the documents that share a token with a query."""
        asked = [q for q in queries if q.tokens]
        if not asked:
            return self.documents().select("collection", "entry_id", F.lit(None).cast("string").alias("query_id"), F.lit(0).alias("score")).where("false")
        pairs = self.spark.createDataFrame([(k, t) for k, q in enumerate(asked) for t in dict.fromkeys(q.tokens)], "k int, token string")
        found = self.postings_of(sorted({t for q in asked for t in q.tokens})).join(F.broadcast(pairs), "token")  # the batch's tokens
        overlap = found.select("doc", "k").repartition("doc").groupBy("doc", "k").agg(F.count("*").alias("overlap"))
        # phrases are sought where a document is read, so that no text goes through the join
        bonus = F.array(*(F.when(F.contains("token_string", F.lit(q.token_string)), PHRASE_BONUS).otherwise(0) for q in asked))
        known = overlap.join(self.documents().select("doc", "collection", "entry_id", bonus.alias("bonus")), "doc")
        k = F.col("k")
        return known.select("collection", "entry_id", F.array(*(F.lit(q.query_id) for q in asked))[k].alias("query_id"), (F.col("overlap") + F.col("bonus")[k]).cast("int").alias("score"))


def build_lexical_index(docs: DataFrame, folder: str | None = None, buckets: int = BUCKETS) -> LexicalIndex:
    """Writes the index of docs (collection, entry_id, tokens, token_string); an entry is in a collection once."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "lexical")
    told = docs.select(F.monotonically_increasing_id().alias("doc"), "collection", "entry_id", "token_string", F.array_distinct("tokens").alias("words")).where("words is not null")
    told.write.parquet(f"{folder}/documents")  # numbers are fixed by this
    index = LexicalIndex(spark, folder, buckets)
    rows = index.documents().select(F.explode("words").alias("token"), "doc").withColumn("bucket", _bucket(F.col("token"), buckets))
    # rebalancing splits a bucket that is large, as one token may be most of it
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "doc").write.partitionBy("bucket").parquet(f"{folder}/postings")
    return index
