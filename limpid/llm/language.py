"""Language identification by a bidirectional gated recurrent network over bytes.

Every position of a text, in lower case and as UTF-8, is labelled from the states of a forward and a
backward recurrent layer; the probabilities of all positions are averaged into those of the document.
Whole texts are read, cut into windows that start from an empty state, so many windows run through
one matrix product per step. The network is small and uses piecewise gates, which keeps the cost per
byte low; it is trained in numpy by backpropagation through time on a bounded sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATES = 8
WINDOW = 64
# windows that run through the network together, and characters of texts that are cut into windows together
BLOCK = 1024
PART_CHARS = 1_000_000
FOLDS = 5
UNKNOWN = "und"
# the sample: training rows per language, those with the smallest hash of their id, and windows that
# are drawn from them, evenly over the languages
SAMPLE_ROWS = 400
SAMPLE_WINDOWS = 6_000
STEPS = 260

# candidates for letters; numerals such as "²" and "Ⅷ" are among them and are told apart one by one
_WORD_SIGN = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a text has a character of one of Unicode's letter classes."""
    return any(m.group().isalpha() for m in _WORD_SIGN.finditer(text))


@dataclass
class Model:
    """Languages; per direction the input table (3 * states, 256) and the recurrent matrix
    (3 * states, states); and the labelling layer. Rows are update gate, reset gate, candidate."""

    languages: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, self.out, self.bias]


def new_model(languages: list[str], states: int = STATES, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    tables = [draw(3 * states, 256, scale=0.4) for _ in range(2)]
    for t in tables:
        t[:states] += 1.0  # states last at first
    return Model(languages, tables, [draw(3 * states, states, scale=0.3) for _ in range(2)],
                 draw(len(languages), 2 * states, scale=0.3), np.zeros((len(languages), 1), np.float32))


def _steps(octets: np.ndarray, live: np.ndarray | None, table: np.ndarray, recurrent: np.ndarray, back: bool,
           trace: list | None = None) -> np.ndarray:
    """States of one direction, (window, states, rows); octets are (window, rows). Dead positions have state 0."""
    length, rows = octets.shape
    states = recurrent.shape[1]
    found = np.empty((length, states, rows), np.float32)
    scaled, mixed = table.copy(), recurrent.copy()
    scaled[:2 * states] = scaled[:2 * states] * np.float32(0.25) + np.float32(0.5)
    mixed[:2 * states] *= np.float32(0.25)
    h = np.zeros((states, rows), np.float32)
    for t in range(length - 1, -1, -1) if back else range(length):
        x = np.take(scaled, octets[t], axis=1)
        m = mixed @ h
        gates = x[:2 * states]
        gates += m[:2 * states]
        np.minimum(np.maximum(gates, 0, out=gates), 1, out=gates)
        z, r, c = gates[:states], gates[states:], x[2 * states:]
        c += r * m[2 * states:]
        n = np.abs(c)
        n += 1
        np.divide(c, n, out=n)
        before, h = h, h - n
        h *= z
        h += n
        if live is not None and not live[t].all():
            h *= live[t]
        if trace is not None:
            trace.append((t, before, z, r, c, n, m[2 * states:]))
        found[t] = h
    return found


def position_probabilities(model: Model, octets: np.ndarray, live: np.ndarray | None) -> np.ndarray:
    """(window, languages, rows)."""
    both = np.concatenate([_steps(octets, live, t, u, k == 1) for k, (t, u) in enumerate(zip(model.tables, model.recurrent))], axis=1)
    scores = np.matmul(model.out, both)
    scores += model.bias
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def gradients(model: Model, octets: np.ndarray, live: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over live positions and its gradient, by backpropagation through time."""
    traces: list[list] = [[], []]
    layers = [_steps(octets, live, t, u, k == 1, traces[k]) for k, (t, u) in enumerate(zip(model.tables, model.recurrent))]
    both = np.concatenate(layers, axis=1)
    scores = np.matmul(model.out, both) + model.bias
    scores -= scores.max(axis=1, keepdims=True)
    share = np.exp(scores)
    share /= share.sum(axis=1, keepdims=True)
    rows = np.arange(len(truth))
    count = float(live.sum())
    loss = -float((np.log(share[:, truth, rows] + 1e-30) * live).sum()) / count
    off = share
    off[:, truth, rows] -= 1
    off *= live[:, None, :] / count
    out = np.einsum("tkb,tsb->ks", off, both)
    bias = off.sum(axis=(0, 2))[:, None]
    into = np.matmul(model.out.T, off)
    states = model.recurrent[0].shape[1]
    tables, recurrent = [], []
    for k, trace in enumerate(traces):
        u = model.recurrent[k]
        gu = np.zeros_like(u)
        gx = np.zeros((len(octets), 3 * states, octets.shape[1]), np.float32)
        carried = np.zeros((states, octets.shape[1]), np.float32)
        for t, before, z, r, c, n, m in reversed(trace):
            dh = (into[t, k * states:(k + 1) * states] + carried) * live[t]
            dc = dh * (1 - z) / (1 + np.abs(c)) ** 2
            dz = dh * (before - n) * np.float32(0.25) * ((z > 0) & (z < 1))
            dr = dc * m * np.float32(0.25) * ((r > 0) & (r < 1))
            gx[t] = np.concatenate([dz, dr, dc])
            dm = np.concatenate([dz, dr, dc * r])
            gu += dm @ before.T
            carried = dh * z + u.T @ dm
        flat = octets.ravel()
        tables.append(np.stack([np.bincount(flat, gx[:, j].ravel(), 256) for j in range(3 * states)]).astype(np.float32))
        recurrent.append(gu)
    return loss, [*tables, *recurrent, out.astype(np.float32), bias.astype(np.float32)]


def windows_of(texts: list[str | None], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(octets (window, n), live length per window, text number per window) of whole texts."""
    parts, sizes = [], []
    for text in texts:
        octets = (text or "").lower().encode("utf-8", "replace")
        sizes.append(len(octets))
        parts.append(octets + bytes(-len(octets) % window))
    flat = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, window)
    counts = np.array([-(-s // window) for s in sizes], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    number = np.arange(len(owner)) - first[owner]
    length = np.minimum(np.array(sizes, np.int64)[owner] - number * window, window)
    return flat, length, owner


def train(texts: list[str], languages: list[str], steps: int = STEPS, batch: int = 256, rate: float = 0.02, seed: int = 5,
          limit: int = SAMPLE_WINDOWS, window: int = WINDOW, states: int = STATES) -> Model:
    """Fit a model by Adam on windows drawn evenly over the languages."""
    names = sorted(set(languages))
    model = new_model(names, states, seed)
    if len(names) < 2:
        return model
    flat, length, owner = windows_of(texts, window)
    truth = np.array([names.index(v) for v in languages])[owner]
    rng = np.random.default_rng(seed)
    share = [np.flatnonzero(truth == k) for k in range(len(names))]
    chosen = np.concatenate([rng.permutation(s)[:max(1, limit // len(names))] for s in share])
    pools = [chosen[truth[chosen] == k] for k in range(len(names))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parts()]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(p, max(1, batch // len(names))) for p in pools])
        live = (np.arange(window)[:, None] < length[rows]).astype(np.float32)
        _, found = gradients(model, flat[rows].T, live, truth[rows])
        pace = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for part, g, (mean, square) in zip(model.parts(), found, moments):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            part -= pace * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return model


def predict(model: Model, texts: list[str | None], window: int = WINDOW, block: int = BLOCK) -> tuple[list[str], np.ndarray]:
    """(language, score) per whole text: the average of the probabilities of all positions.

    A text that is null or has no letter is ``und`` with score 0, and so is any text if no language was learned.
    """
    known = len(model.languages)
    readable = [bool(t and known and has_letter(t)) for t in texts]
    sums = np.zeros((max(known, 1), len(texts)))
    if known:
        flat, length, owner = windows_of([t if ok else None for t, ok in zip(texts, readable)], window)
        order = np.argsort(length < window, kind="stable")
        for part in range(0, len(order), block):
            rows = order[part:part + block]
            full = bool((length[rows] == window).all())
            live = None if full else (np.arange(window)[:, None] < length[rows]).astype(np.float32)
            share = position_probabilities(model, np.ascontiguousarray(flat[rows].T), live)
            total = share.sum(axis=0) if full else (share * live[:, None, :]).sum(axis=0)
            for k in range(known):
                sums[k] += np.bincount(owner[rows], total[k], len(texts))
    whole = sums.sum(axis=0)
    best = sums.argmax(axis=0)
    score = np.where(readable, sums.max(axis=0) / np.maximum(whole, 1e-30), 0.0)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, readable)], np.clip(score, 0.0, 1.0)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """True for one fold of ids, by their decimal text. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_language(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_windows: int = SAMPLE_WINDOWS) -> Model:
    """Model trained on rows of ``docs`` (doc_id, text, lang) outside the held-out fold with a language.

    The sample has two bounds: at most ``sample_rows`` rows per language are gathered in one task, the
    ones with the smallest hash of their id, and of all their windows at most ``sample_windows``, drawn
    evenly over the languages, are learned from. Rows without id, language or letters teach nothing.
    """
    usable = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    key = F.xxhash64("doc_id")
    # the ids are chosen without the texts, in 64 parts per language first, so that no task sees more
    # than a fixed number of rows of a frequent one; only chosen rows are sorted again with their texts
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(64))).orderBy(key, "doc_id")
    first = Window.partitionBy("lang").orderBy(key, "doc_id")
    ids = usable.select("doc_id", "lang").distinct()
    for window in (part, first):
        ids = ids.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= sample_rows).select("doc_id", "lang")
    again = Window.partitionBy("lang").orderBy(key, "doc_id", "text")
    sample = (usable.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])
              .withColumn("__n", F.row_number().over(again)).where(F.col("__n") <= sample_rows).select("lang", "text"))
    shapes = "part int, flat array<float>, languages array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((lang, text) for b in batches for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        rows = [r for r in rows if has_letter(r[1])]
        if rows:
            model = train([r[1] for r in rows], [r[0] for r in rows], limit=sample_windows)
            parts = model.parts()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([p.ravel() for p in parts], pa.list_(pa.float32())),
                 pa.array([model.languages] * len(parts), pa.list_(pa.string()))], names=["part", "flat", "languages"])

    found = sorted(sample.coalesce(1).mapInArrow(run, shapes).collect())
    if not found:
        return Model([], [], [], np.empty((0, 0), np.float32), np.empty((0, 1), np.float32))
    model = new_model(list(found[0].languages))
    arrays = [np.array(r.flat, np.float32).reshape(p.shape) for r, p in zip(found, model.parts())]
    return Model(model.languages, arrays[:2], arrays[2:4], arrays[4], arrays[5])


def with_language(docs: DataFrame, model: Model, to: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` (text, ...) with the predicted language and its probability; all rows and columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables, model.recurrent, model.out, model.bias))

    @F.pandas_udf("lang string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        # texts of one batch in parts, so that long texts do not fill the memory together
        names, scores, listed = [], [], texts.tolist()
        part, held = [], 0
        for k, text in enumerate(listed):
            part.append(text)
            held += len(text or "")
            if held > PART_CHARS or k == len(listed) - 1:
                found, share = predict(Model(*shared.value), part)
                names += found
                scores += share.tolist()
                part, held = [], 0
        return pd.DataFrame({"lang": names, "score": scores})

    # not repeated: a filter on the prediction must not run the network a second time
    found = docs.withColumn("__language", label.asNondeterministic()(F.col("text")))
    return found.withColumn(to, F.col("__language.lang")).withColumn(score, F.col("__language.score")).drop("__language")


def op5_language_id(spark, folder: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit_language(docs)
    return with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op5_language_id": op5_language_id}
