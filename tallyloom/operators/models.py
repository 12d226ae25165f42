"""Places where a model plugs in: describing activity and encoding text. The defaults are deterministic and trained on nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tallyloom.functions.text import prompt


def describe_activity(activity: DataFrame, describe: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """activity (type, name, ...) with description. describe answers a batch of prompts; without it the prompt stands."""
    asked = activity.withColumn("_prompt", prompt(F.col("name"), F.col("type")))
    if describe is None:
        return asked.withColumnRenamed("_prompt", "description")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(description=describe(b["_prompt"].tolist())).drop(columns="_prompt")

    return asked.mapInPandas(run, T.StructType([*activity.schema.fields, T.StructField("description", T.StringType())]))


def hashing_encoder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Signed counts of words in hashed places, of length one."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = xxh64_intdigest(w, 0)
                out[i, h % dims] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def encode_texts(df: DataFrame, col: str, encode: Callable[[list[str]], np.ndarray] | None = None, out: str = "embedding") -> DataFrame:
    """df with a vector for each text, by batches."""
    encode = encode or hashing_encoder()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encode(texts.tolist())))

    return df.withColumn(out, vectors(col))


def stored_vectors_agree(stored: DataFrame, fresh: DataFrame, id_: str, vec: str = "embedding", least: float = 0.99) -> DataFrame:
    """id, cosine of the stored with the fresh vector, and whether it is at least `least`."""
    from tallyloom.functions.text import cosine

    b = fresh.select(id_, F.col(vec).alias("_fresh"))
    return stored.join(b, id_).select(id_, cosine(F.col(vec), F.col("_fresh")).alias("cosine")).withColumn("agrees", F.col("cosine") >= least)
