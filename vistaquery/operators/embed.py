"""Pluggable embedders: vectors of documents, and of the distinct texts of a batch of queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts -> vectors; called on the executors, once a chunk.
Embedder = Callable[[list[str]], list[list[float]]]
#: Collections of sentences and of words, which may have different models.
SENTENCES, WORDS = ("content_narrative", "context_narrative", "ocr_content"), ("lexical_keywords", "other_data")


def embed(docs: DataFrame, models: dict[str, Embedder], chunk: int = 32) -> DataFrame:
    """docs (collection, document, ...) with embedding, by the model of the collection's kind (sentence or word)."""
    schema = T.StructType([*docs.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames):
        for pdf in frames:
            out = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            for kind, names in (("sentence", SENTENCES), ("word", WORDS)):
                rows = pdf.index[pdf["collection"].isin(names)]
                for k in range(0, len(rows), chunk):
                    part = rows[k : k + chunk]
                    for i, v in zip(part, models[kind](pdf.loc[part, "document"].tolist())):
                        out[i] = [float(x) for x in v]
            yield pdf.assign(embedding=out)

    return docs.mapInPandas(run, schema)
