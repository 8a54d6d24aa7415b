"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features say which n-grams of 4 to 6 characters a whole text has, hashed into a fixed number of
slots. Slots whose counts do not tell the classes apart are left out. A slot's value is its log-count ratio: how much likelier toxic training texts have it than
others. A logistic regression over these values is fitted (Wang and Manning, "Baselines and bigrams",
2012). Its weights, already multiplied by the ratios, are one vector of fixed size, so scoring is a
scan with one sum per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (4, 5, 6)
SLOT_BITS = 20
# labelled rows the classifier is fitted on: those with the smallest hash of their id
SAMPLE_ROWS = 10_000
FOLDS = 5
# standard errors that a slot's ratio must differ from 0, and training texts that must have it
LEAST_ERRORS = 3.0
LEAST_TEXTS = 3


def slots_of(text: str | None, owner: np.ndarray, bits: int = SLOT_BITS) -> np.ndarray:
    """Distinct slots of the character n-grams of a text in lower case. ``owner`` is scratch space
    with a number per slot; what it holds does not matter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    rolled, found = codes, []
    for size in range(2, max(SIZES) + 1):
        if len(rolled) < 2 or len(codes) < size:
            break
        rolled = rolled[:len(codes) - size + 1] * np.uint32(0x01000193) + codes[size - 1:]
        if size in SIZES:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            found.append(mixed >> np.uint32(32 - bits))
    if not found:
        return np.empty(0, np.int64)
    slots = np.concatenate(found).astype(np.int64)
    # the last of equal slots owns the place, so exactly one of them is kept
    number = np.arange(len(slots), dtype=owner.dtype)
    owner[slots] = number
    return slots[owner[slots] == number]


def fit(texts: list[str | None], labels: np.ndarray, bits: int = SLOT_BITS, epochs: int = 15, rate: float = 0.1,
        decay: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, intercept). With one class only no slot has a weight."""
    size, owner = 1 << bits, np.zeros(1 << bits, np.int32)
    total, n = float(labels.sum()), len(labels)
    prior = (total + 1.0) / (n + 2.0)
    bias = float(np.log(prior / (1 - prior)))
    if not 0 < total < n:
        return np.empty(0, np.int64), np.empty(0, np.float32), bias
    seen = np.zeros((2, size))
    for text, label in zip(texts, labels):
        seen[int(label)][slots_of(text, owner, bits)] += 1
    ratio = np.log(((seen[1] + 1) / (total + 2)) / ((seen[0] + 1) / (n - total + 2)))
    error = np.sqrt(1 / (seen[1] + 1) + 1 / (seen[0] + 1) - 1 / (total + 2) - 1 / (n - total + 2))
    kept = np.flatnonzero((np.abs(ratio) >= LEAST_ERRORS * error) & (seen.sum(axis=0) >= LEAST_TEXTS))
    place, ratio = np.full(size, -1), ratio[kept]
    place[kept] = np.arange(len(kept))
    lists = [p[p >= 0] for p in (place[slots_of(t, owner, bits)] for t in texts)]
    weights, squares, bias_square = np.zeros(len(kept)), np.full(len(kept), 1e-8), 1e-8
    order, rng = np.arange(n), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for part in range(0, n, 32):
            chosen = order[part:part + 32]
            flat = np.concatenate([lists[i] for i in chosen])
            of = np.repeat(np.arange(len(chosen)), [len(lists[i]) for i in chosen])
            z = np.bincount(of, weights[flat] * ratio[flat], len(chosen)) + bias
            off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]
            step = np.bincount(flat, off[of] * ratio[flat], len(kept)) + decay * weights
            squares += step ** 2
            weights -= rate * step / np.sqrt(squares)
            bias_square += off.sum() ** 2
            bias -= rate * float(off.sum()) / np.sqrt(bias_square)
    return kept, (weights * ratio).astype(np.float32), bias


def score_texts(texts: list[str | None], model: tuple[np.ndarray, np.ndarray, float], bits: int = SLOT_BITS) -> np.ndarray:
    """Probability of label 1 for each whole text; a text without n-grams has that of the intercept."""
    slots, weights, bias = model
    dense, owner = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.int32)
    dense[slots] = weights
    z = np.array([dense[slots_of(t, owner, bits)].sum(dtype=np.float64) for t in texts]) + bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """True for one fold of ids, by their decimal text. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Model fitted on the labelled training rows: ids outside the held-out fold, toxic 0 or 1.

    At most ``sample_rows`` rows take part, the ones with the smallest hash of their id; this is the
    only bound. They are gathered in one task, which returns the weights of the kept slots. A
    document with several labels has the largest. Without any labelled row all scores are 0.5.
    """
    order = F.xxhash64("doc_id")
    wanted = (labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(order, "doc_id").limit(sample_rows))
    sample = (docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
              .orderBy(order, "doc_id", "text").limit(sample_rows).select("toxic", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labelled = [], []
        for batch in batches:
            labelled += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        if texts:
            slots, weights, bias = fit(texts, np.array(labelled, np.float64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([slots], pa.list_(pa.int64())), pa.array([weights], pa.list_(pa.float32())), pa.array([bias])],
                names=["slots", "weights", "bias"])

    found = sample.coalesce(1).mapInArrow(run, "slots array<bigint>, weights array<float>, bias double").collect()
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.float32), 0.0
    return np.array(found[0].slots, np.int64), np.array(found[0].weights, np.float32), found[0].bias


def with_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], to: str = "score") -> DataFrame:
    """``docs`` (text, ...) with the probability of label 1. Null and empty texts are scored too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts.tolist(), shared.value))

    return docs.withColumn(to, score(F.col("text")))


def op3_toxicity(spark, folder: str) -> DataFrame:
    """Score and label of all documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return with_toxicity(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
