"""Text embedding behind one interface: a Spark ML encoder, or any model callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdrift.functions import scalars as S

# Fixed value: width of the stored vectors.
DIMENSIONS = 768
MODEL_BATCH = 32

Encoder = Callable[[DataFrame, str, str], DataFrame]


def hashed_encoder(dimensions: int = DIMENSIONS) -> Encoder:
    """Hashed term counts scaled to length one, computed inside Spark."""

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        filled = df.withColumn("_text", F.coalesce(text, F.lit("")))
        words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+").transform(filled)
        counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions).transform(words)
        unit = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(counts)
        return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_text", "_words", "_counts", "_unit")

    return encode


# Models that this worker process holds, by name.
_MODELS: dict[str, Callable[[list[str]], list]] = {}


def _model(load: Callable[[], Callable[[list[str]], list]], name: str | None) -> Callable[[list[str]], list]:
    if name is None:
        return load()
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def model_encoder(load: Callable[[], Callable[[list[str]], list]], batch: int = MODEL_BATCH, name: str | None = None) -> Encoder:
    """Encoder around any model: ``load`` returns texts -> vectors.

    It runs once per task, or with ``name`` once per worker process. Texts of like length go to the model together.
    """

    @F.pandas_udf("array<float>")
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(load, name)
        for series in texts:
            values = series.tolist()
            order = sorted(range(len(values)), key=lambda i: len(values[i]))
            out: list = [None] * len(values)
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                for i, vector in zip(part, model([values[i] for i in part]), strict=True):
                    out[i] = vector
            yield pd.Series(out, index=series.index)

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, vectors(F.coalesce(text, F.lit(""))))

    return encode


def embed_text(df: DataFrame, text: str, out: str, kind: str, encoder: Encoder | None = None) -> DataFrame:
    """Vector of ``kind`` prefix + text; NULL where there is no text."""
    told: Column = S.has_text(F.col(text))
    prefixed = df.withColumn("_task", F.when(told, S.prefixed(F.col(text), kind)))
    encoded = (encoder or hashed_encoder())(prefixed, "_task", out)
    return encoded.withColumn(out, F.when(F.col("_task").isNotNull(), F.col(out))).drop("_task")


def embed_events(events: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """Fill the prompt and completion vectors of parsed events."""
    plain = events.drop("prompt_embedding", "completion_embedding")
    prompts = embed_text(plain, "prompt_text", "prompt_embedding", "query", encoder)
    return embed_text(prompts, "completion_text", "completion_embedding", "document", encoder)
