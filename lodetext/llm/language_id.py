"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of WINDOW bytes in both directions, gives every position language probabilities, and a document the mean over all positions of
its letters (bytes of ASCII letters and of other characters), in all windows of its whole text. It is trained with numpy by backpropagation through time on
a bounded sample of labelled documents (SAMPLE for each language, chosen by a hash of id and text), with Adam. Gates use piecewise linear
forms of the logistic function and the hyperbolic tangent, which cost no exponential at each byte.

Defined cases: a null text, or one without a letter, is `und` with score 0; without labelled documents to learn from every text is `und`; a null doc_id counts as held out;
repeated rows give repeated rows; a null lang is not learned from; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodetext.llm import shared

WINDOW, HIDDEN, BLOCK = 128, 8, 2048
#: The bounds of what is learned from: documents for each language, windows for each document.
SAMPLE, WINDOWS = 400, 6
#: The score from which a language that isn't the label's contradicts the label.
CONTRADICTED = 0.95

_COUNTS = np.zeros(256, np.float32)
_COUNTS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@dataclass
class Model:
    languages: list[str]
    inputs: list[np.ndarray]  # for both directions: 256 x 3H, gates z, r and candidate
    states: list[np.ndarray]  # H x 3H
    out: np.ndarray  # 2H x languages
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, self.out, self.bias]


def new_model(languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    inputs = [draw(256, 3 * hidden, scale=0.5) for _ in range(2)]
    return Model(languages, inputs, [draw(hidden, 3 * hidden, scale=0.4) for _ in range(2)], draw(2 * hidden, len(languages), scale=0.3), np.zeros(len(languages), np.float32))


def _states(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The state after each position (T x B x H) for bytes x (T x B)."""
    steps, rows = x.shape
    n = u.shape[0]
    out = np.empty((steps, rows, n), np.float32)
    h = np.zeros((rows, n), np.float32)
    a, s, gates = np.empty((rows, 3 * n), np.float32), np.empty((rows, 3 * n), np.float32), np.empty((rows, 2 * n), np.float32)
    for t in range(steps):
        np.take(table, x[t], axis=0, out=a, mode="clip")
        np.dot(h, u, out=s)
        np.add(a[:, : 2 * n], s[:, : 2 * n], out=gates)
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        z, r = gates[:, :n], gates[:, n:]
        c = s[:, 2 * n :] * r
        c += a[:, 2 * n :]
        np.clip(c, -1, 1, out=c)
        if keep is not None:
            keep[t] = (h, z.copy(), r.copy(), c, s[:, 2 * n :].copy())
        step = c - h
        step *= z
        h = np.add(h, step, out=out[t])
    return out


def position_probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """T x B x languages, for bytes x (T x B)."""
    logits = _logits(model, _states(x, model.inputs[0], model.states[0]), _states(x[::-1], model.inputs[1], model.states[1])[::-1])
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def _logits(model: Model, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    n = ahead.shape[-1]
    return ahead @ model.out[:n] + back @ model.out[n:] + model.bias


def _back(x, u, keep, grad, d_table, d_u):
    """Adds to d_table and d_u the gradients through time, given that of the states (T x B x H)."""
    n = u.shape[0]
    dh = np.zeros_like(grad[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, c, su = keep[t]
        dh = dh + grad[t]
        dc = dh * z * ((c > -1) & (c < 1))
        dz = dh * (c - h) * (0.25 * ((z > 0) & (z < 1)))
        dr = dc * su * (0.25 * ((r > 0) & (r < 1)))
        da = np.concatenate((dz, dr, dc), 1).astype(np.float32)
        ds = np.concatenate((dz, dr, dc * r), 1).astype(np.float32)
        np.add.at(d_table, x[t], da)
        d_u += h.T @ ds
        dh = dh * (1 - z) + ds @ u.T


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 90, rows: int = 384, rate: float = 0.02, seed: int = 7) -> Model:
    """windows: N x WINDOW bytes; labels: the index of each one's language."""
    model = new_model(languages, seed=seed)
    params = model.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rng = np.random.default_rng(seed)
    n = model.states[0].shape[0]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), min(rows, len(windows)))
        x, y = np.ascontiguousarray(windows[pick].T), labels[pick]
        kept: list[dict] = [{}, {}]
        ahead = _states(x, model.inputs[0], model.states[0], kept[0])
        back = _states(x[::-1], model.inputs[1], model.states[1], kept[1])[::-1]
        p = _logits(model, ahead, back)
        p = np.exp(p - p.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        weight = _COUNTS[x]
        p[:, np.arange(len(y)), y] -= 1
        p *= (weight / max(1.0, float(weight.sum())))[..., None]
        p = p.astype(np.float32)
        flat = p.reshape(-1, len(languages))
        grads = [np.zeros_like(q) for q in params]
        grads[4][:n] = ahead.reshape(-1, n).T @ flat
        grads[4][n:] = np.ascontiguousarray(back).reshape(-1, n).T @ flat
        grads[5][:] = flat.sum(0)
        _back(x, model.states[0], kept[0], p @ model.out[:n].T, grads[0], grads[2])
        _back(x[::-1], model.states[1], kept[1], (p @ model.out[n:].T)[::-1], grads[1], grads[3])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for q, g, m, v in zip(params, grads, first, second, strict=True):
            g *= min(1.0, 1.0 / max(size, 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def has_letter(text: str) -> bool:
    """Whether a character of any script is a letter; numbers such as fractions and numerals aren't."""
    return any(map(str.isalpha, text))


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts (the last of each filled up with spaces), and each one's text."""
    times = [-(-len(t) // WINDOW) for t in texts]
    data = b"".join(t.ljust(k * WINDOW) for t, k in zip(texts, times, strict=True))
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), times)


def classify(model: Model, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    windows, of = _windows([t or b"" for t in texts])
    total = np.zeros((len(texts), len(model.languages)))
    for k in range(0, len(windows), BLOCK):
        x = np.ascontiguousarray(windows[k : k + BLOCK].T)
        p = position_probabilities(model, x)
        p *= _COUNTS[x][..., None]
        np.add.at(total, of[k : k + BLOCK], p.sum(0))
    weight = total.sum(1)
    best = total.argmax(1)
    names, scores = [], []
    for k, t in enumerate(texts):
        if weight[k] > 0 and has_letter(t.decode()):
            names.append(model.languages[best[k]])
            scores.append(min(1.0, float(total[k, best[k]] / weight[k])))
        else:
            names.append("und")
            scores.append(0.0)
    return names, scores


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from at most `sample` rows (doc_id, text, lang) of each language, those with the least hashes of id and text."""
    rows = labelled.where("lang is not null and text is not null and doc_id is not null")
    # windows spread over the whole text, so that what reaches the driver is bounded
    at = lambda j: F.floor(F.greatest(F.length("text") - WINDOW, F.lit(0)) * F.lit(j / max(1, WINDOWS - 1)) + 1).cast("int")
    parts = F.array(*[F.substring(F.col("text"), at(j), F.lit(WINDOW)) for j in range(WINDOWS)])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text", F.lit("fit")), "doc_id"))  # cut in each input partition before rows are moved
    hashed = rows.select("doc_id", "lang", parts.alias("parts"), place.alias("place"))
    chosen = hashed.where(F.col("place") <= sample).select("doc_id", "lang", "parts").collect()
    chosen.sort(key=lambda r: (r.doc_id, r.lang, r.parts))
    languages = sorted({r.lang for r in chosen})
    texts, labels = [], []
    for r in chosen:
        for part in sorted(set(r.parts)):
            if has_letter(part):
                texts.append(part.encode()[:WINDOW].ljust(WINDOW))
                labels.append(languages.index(r.lang))
    if not texts:
        return None
    return train(np.frombuffer(b"".join(texts), np.uint8).reshape(-1, WINDOW), np.array(labels), languages)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        for ids, texts in shared.byte_batches(batches, ["doc_id", "text"]):
            names, scores = classify(model, texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def without_rejected(docs: DataFrame, model: Model | None, contradicted: float = CONTRADICTED) -> DataFrame:
    """The rows of docs whose text has a language; texts are read once and no row is moved.

    A row whose `lang` is another than the network's goes where the network's score is `contradicted` or more; a null `lang` becomes the network's.
    Texts without letters have no language. Low scores alone reject nothing: short texts have them though nothing is wrong with them.
    """
    if model is None:
        return docs.limit(0)
    labelled = "lang" in docs.columns and docs.schema["lang"].dataType.simpleString() == "string"

    def run(batches):
        for b in batches:
            found = []
            for (texts,) in shared.byte_batches([b.select(["text"])], ["text"]):
                found += list(zip(*classify(model, texts), strict=True))
            given = b.column("lang").to_pylist() if labelled else [None] * len(found)
            keep = [name != "und" and (own in (None, name) or score < contradicted) for (name, score), own in zip(found, given, strict=True)]
            if labelled:
                k = b.schema.get_field_index("lang")
                b = b.set_column(k, b.schema.field(k), pa.array([name if own is None else own for (name, _), own in zip(found, given, strict=True)], b.schema.field(k).type))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").where(shared.id_remainder("doc_id", 5) != 0))
    return predict(docs, model).select("doc_id", F.coalesce(shared.id_remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")
