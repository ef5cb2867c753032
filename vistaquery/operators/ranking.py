"""The three rankers and their fusion.  Every query of a batch goes through one plan; the
queries are literals in it, so each scans the rows once and nothing is joined.  Top-k windows
are cut in every task before the shuffle (WindowGroupLimit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masks import condition, specificity
from ..plans.query import QuerySpec

#: Weights of the ranked lists (others: OTHER_WEIGHT), and the constant of the fusion.
WEIGHTS = {
    "content_narrative": 1.0, "context_narrative": 1.0, "lexical_keywords": 0.7, "ocr_content": 0.4, "other_data": 0.1,
    "content_narrative_lexical": 0.8, "context_narrative_lexical": 0.8, "lexical_keywords_lexical": 1.0,
    "ocr_content_lexical": 0.9, "other_data_lexical": 0.5, "context_narrative_chrono": 1.0,
}
OTHER_WEIGHT, RRF_K, ID_LENGTH = 0.2, 60, 105
CHRONO = "context_narrative_chrono"


def depth(n: int, per: int) -> int:
    """Of a ranked list, for n results."""
    return min(per * n, 500)


def _top(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def lexical_candidates(docs: DataFrame, queries: list[QuerySpec]) -> DataFrame:
    """docs (collection, entry_id, tokens, token_string) that share a token with a query, with query_id and score."""
    asked = [q for q in queries if q.tokens]
    if not asked:
        return docs.select("collection", "entry_id", F.lit(None).cast("string").alias("query_id"), F.lit(0).alias("score")).where("false")
    # token to the numbers of the queries that hold it: a row is dealt to those it shares a token with, not to all
    by_token = {t: [k for k, q in enumerate(asked) if t in q.tokens] for t in sorted({t for q in asked for t in q.tokens})}
    holders = F.create_map(*(x for t, ks in by_token.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))))
    shared = F.array_intersect("tokens", F.array(*map(F.lit, by_token)))
    rows = docs.select("collection", "entry_id", "token_string", F.flatten(F.transform(shared, lambda t: holders[t])).alias("hits"))
    # not explode() nor a filter of null tokens: these go down to the scan as conditions, for which all texts are tokenized again
    pairs = rows.select("collection", "entry_id", "token_string", "hits", F.explode_outer(F.array_distinct("hits")).alias("k")).where("k is not null")
    named = F.array(*(F.struct(F.lit(q.query_id).alias("query_id"), F.lit(q.token_string).alias("token_string")) for q in asked))
    q = named[F.col("k")]
    score = F.size(F.filter("hits", lambda x: x == F.col("k"))) + F.when(F.contains(F.col("token_string"), q["token_string"]), 2).otherwise(0)
    return pairs.select("collection", "entry_id", q["query_id"].alias("query_id"), score.alias("score"))


def lexical_rank(docs: DataFrame, queries: list[QuerySpec], n: int) -> DataFrame:
    hits = lexical_candidates(docs, queries).where("score > 0")
    ranked = _top(hits, ["query_id", "collection"], [F.desc("score"), "entry_id"], depth(n, 50))
    return ranked.select("query_id", F.concat("collection", F.lit("_lexical")).alias("list"), "entry_id", (-F.col("score")).cast("double").alias("distance"), "rank")


def chrono_rank(docs: DataFrame, queries: list[QuerySpec], n: int, date_field: str = "master_date") -> DataFrame:
    """docs: entry_id, date_reliability and the date's part columns.  A list per date filter of a query."""
    matches = []
    for q in queries:
        for i, f in enumerate(q.filters):
            found = F.struct(F.lit(q.query_id).alias("query_id"), F.lit(i).alias("filter_no"), F.lit(specificity(f.start_mask, f.end_mask)).alias("base"))
            matches.append(F.when(condition(date_field, f), found))
    if not matches:
        return docs.select(F.lit("").alias("query_id"), F.lit("").alias("list"), "entry_id", F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).where("false")
    ts = date_field.replace("date", "ts")
    hits = docs.select("entry_id", F.col(ts).alias("ts"), "date_reliability", F.explode(F.array_compact(F.array(*matches))).alias("m"))
    hits = hits.select("m.query_id", "m.filter_no", "entry_id", "ts", (F.col("m.base") + F.when(F.col("date_reliability") == "high", 1).otherwise(0)).alias("score"))
    ranked = _top(hits, ["query_id", "filter_no"], [F.desc("score"), F.desc_nulls_last("ts"), "entry_id"], depth(n, 50))
    return ranked.select("query_id", F.concat(F.lit(f"{CHRONO}_"), F.col("filter_no")).alias("list"), "entry_id", (-F.col("score")).cast("double").alias("distance"), "rank")


def cosine_distance(a: Column, vector: list[float]) -> Column:
    """1 - cosine, in double precision, rounded to 9 places."""
    v = F.array(*(F.lit(float(x)) for x in vector))
    a = F.transform(a, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(a, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    own = sum(float(x) ** 2 for x in vector) ** 0.5
    return F.round(1 - dot / (norm * F.lit(own)), 9)


def semantic_rank(vectors: DataFrame, queries: list[QuerySpec], n: int) -> DataFrame:
    """vectors: collection, entry_id, embedding.  Exact nearest by cosine; queries without a vector or tokens have none."""
    specs = [F.struct(F.lit(q.query_id).alias("query_id"), cosine_distance(F.col("embedding"), list(q.vector)).alias("distance")) for q in queries if q.vector and q.tokens]
    if not specs:
        return vectors.select(F.lit("").alias("query_id"), F.lit("").alias("list"), "entry_id", F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).where("false")
    hits = vectors.select("collection", "entry_id", F.explode(F.array(*specs)).alias("q")).select("collection", "entry_id", "q.query_id", "q.distance").where("distance is not null")
    ranked = _top(hits, ["query_id", "collection"], ["distance", "entry_id"], depth(n, 10))
    return ranked.select("query_id", F.col("collection").alias("list"), "entry_id", "distance", "rank")


def collapse_chrono(hits: DataFrame) -> DataFrame:
    """All chronological lists of a query as one: entries by the sum of their reciprocal ranks."""
    chrono = F.col("list").startswith(f"{CHRONO}_")
    own = hits.where(chrono).groupBy("query_id", "entry_id").agg(F.round(F.sum(1 / (F.col("rank") + RRF_K)), 9).alias("s"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "entry_id")))
    ranked = ranked.select("query_id", F.lit(CHRONO).alias("list"), "entry_id", (-F.col("s")).alias("distance"), "rank")
    return hits.where(~chrono).unionByName(ranked)


def fuse(hits: DataFrame, n: int) -> DataFrame:
    """Weighted reciprocal-rank fusion: query_id, entry_id, score and rank (from 0) of the best n of each query."""
    table = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    weight = F.coalesce(F.try_element_at(table, F.col("list")), F.lit(OTHER_WEIGHT))
    sums = collapse_chrono(hits).groupBy("query_id", F.substring("entry_id", 1, ID_LENGTH).alias("entry_id")).agg(F.round(F.sum(weight / (F.col("rank") + RRF_K)), 9).alias("score"))
    ranked = _top(sums, ["query_id"], [F.desc("score"), "entry_id"], n)
    return ranked.select("query_id", "entry_id", "score", (F.col("rank") - 1).alias("rank"))


def search(docs: DataFrame, dated: DataFrame, vectors: DataFrame, queries: list[QuerySpec], n: int) -> DataFrame:
    return fuse(lexical_rank(docs, queries, n).unionByName(chrono_rank(dated, queries, n)).unionByName(semantic_rank(vectors, queries, n)), n)
