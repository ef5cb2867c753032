"""Descriptions of packed batches, in rounds that are committed one by one.

A round sends some batches, one call each, side by side; its rows are a table of their own, there
as a whole when Spark has committed it.  Requests are dealt to rounds once, and a round reads its
own alone; rounds grow with the list, so there are some dozens of them at most for any number of batches.  A run that is started again goes on after the last
committed round and calls nothing twice that was committed.  Calls after the service's first
limit are useless: what a round got beyond that batch is left out, and no further round is sent."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import locate, new_folder
from . import ingest

#: Descriptions before the first commit, and reasons of outcomes.
FLUSH = 128
#: By default a round sends twice as many batches as the one before, up to all batches' number by this.
ROUNDS = 32
NOTHING = "No description was generated for this media item."
LIMITED = "Gemini quota reached while generating descriptions."
REASONS = {"unprepared": "Media item could not be prepared for Gemini analysis.", "too_large": "Prepared Gemini inline request exceeds the configured byte limit."}


class RateLimited(Exception):
    """The service takes no more requests for now."""


#: The rows of one batch to the text of its response; raises RateLimited, or anything else for a failed call.
Call = Callable[[pd.DataFrame], str]
ANSWER = "batch_no long, text string, limited boolean, error string"


def _answers(batches: DataFrame, call: Call) -> DataFrame:
    """One call a batch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        text, limited, error = None, False, None
        try:
            text = call(pdf.sort_values(["position", "entry_id"], ignore_index=True))
        except RateLimited:
            limited = True
        except Exception as e:  # a failed call fails its batch, not the run
            error = str(e)
        return pd.DataFrame({"batch_no": [int(pdf["batch_no"].iloc[0])], "text": [text], "limited": [limited], "error": [error]})

    return batches.groupBy("batch_no").applyInPandas(run, ANSWER)


def round_ends(batches: int, first: int) -> list[int]:
    """The last batch of each round, of which the first sends that many; the last end may be beyond the last batch."""
    ends, size = [first], first
    while ends[-1] < batches:
        size = min(2 * size, max(first, -(-batches // ROUNDS)))
        ends.append(ends[-1] + size)
    return ends


def _dealt(spark: SparkSession, rows: DataFrame, number: Column) -> DataFrame:
    """rows in a folder for each round."""
    path, dealt = f"{new_folder(spark, 'requests')}/rows", rows.withColumn("_round", number.cast("int"))
    dealt.hint("rebalance", "_round").write.partitionBy("_round").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def describe_rounds(batches: DataFrame, call: Call, folder: str, per_round: int | None = None, count: int = 1, stop_after: int | None = None) -> DataFrame:
    """batches (entry_id, position, batch_no, outcome, ...) with status, reason and description.

    Status: described, failed, or rate_limited for all batches from the first limited one on.
    folder: of the rounds, which a later run with the same batches goes on from.  per_round:
    batches of each round; by default the first has as many as hold FLUSH items of count each, and
    further ones grow (round_ends).  stop_after: rounds
    after which this run ends, leaving the others without status."""
    spark = batches.sparkSession
    last = batches.agg(F.max("batch_no")).first()[0] or 1
    ends = round_ends(last, -(-FLUSH // count))
    number = F.floor((F.col("batch_no") - 1) / per_round) if per_round else sum((F.when(F.col("batch_no") > e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    dealt = _dealt(spark, batches, number)
    done, sent = [], 0
    for k in range(-(-last // per_round) if per_round else len(ends)):
        own = f"{folder}/round={k}"
        path, fs = locate(spark, f"{own}/_SUCCESS")
        if not fs.exists(path):
            if sent == stop_after:
                break
            asked = dealt.where((F.col("_round") == k) & (F.col("outcome") == "packed")).drop("_round")
            _answers(asked, call).write.mode("overwrite").parquet(own)
            sent += 1
        done.append(own)
        if not spark.read.schema(ANSWER).parquet(own).where("limited").isEmpty():
            break
    answers = spark.read.schema(ANSWER).parquet(*done) if done else spark.createDataFrame([], ANSWER)
    return _outcomes(dealt, answers, len(done))


def _outcomes(batches: DataFrame, answers: DataFrame, rounds: int) -> DataFrame:
    first = answers.where("limited").agg(F.min("batch_no").alias("_limit"))
    keys = batches.where("outcome = 'packed'").select("batch_no", "entry_id")
    said = ingest.parse_responses(answers.where("text is not null").select("batch_no", "text"), keys)
    rows = batches.join(answers.select("batch_no", "error", F.lit(True).alias("_sent")), "batch_no", "left").join(said, ["batch_no", "entry_id"], "left").join(F.broadcast(first))  # first: one row
    beyond = F.coalesce(F.col("batch_no") >= F.col("_limit"), F.lit(False))
    reached = F.col("_sent").isNotNull() | ((F.col("outcome") != "packed") & (F.col("_round") < rounds))
    status = F.when(beyond, "rate_limited").when(F.col("description").isNotNull(), "described").when(reached, "failed")
    known = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    reason = F.when(beyond, LIMITED).when(F.col("description").isNotNull(), "").when(reached, F.coalesce(F.try_element_at(known, F.col("outcome")), "error", F.lit(NOTHING)))
    out = rows.withColumns({"status": status, "reason": reason, "description": F.when(~beyond, F.col("description"))})
    return out.drop("_limit", "_sent", "error", "_round")
