"""Language identification by a bidirectional gated recurrent network over
bytes, trained in numpy by backpropagation through time.

Whole texts (UTF-8) are read in windows of ``WINDOW`` bytes, each direction
starting anew in a window.  Every byte position gets language probabilities from
both states, and a document's are the mean over all its positions.  Gates are
piecewise linear (clipped), so a position costs few operations.

The network is fitted on a bounded sample: about ``per_lang`` documents of each
language (chosen by a hash), ``windows`` windows from anywhere in each, and at most
``max_langs`` languages.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text if nothing can be learned; null languages and null texts are not
learned from; a null doc_id is not held out, and teaches nothing; repeated rows
score alike; long texts are read whole; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

WINDOW = 64
HIDDEN = 8
PAD = 256
_BATCH = 2048


@dataclass
class GruModel:
    """Per direction: ``x`` (3h, 257) input columns with biases, ``u`` (3h, h);
    rows are update, reset and candidate.  ``out`` (langs, 2h) and ``bias``."""

    langs: list[str]
    x: list[np.ndarray]
    u: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.x, *self.u, self.out, self.bias]


def new_model(langs: list[str], seed: int = 5) -> GruModel:
    r = np.random.default_rng(seed)
    n, h = len(langs), HIDDEN
    x = [(r.standard_normal((3 * h, PAD + 1)) * 0.3).astype(np.float32) for _ in range(2)]
    u = [(r.standard_normal((3 * h, h)) / np.sqrt(h) * 0.5).astype(np.float32) for _ in range(2)]
    return GruModel(langs, x, u, (r.standard_normal((n, 2 * h)) * 0.3).astype(np.float32), np.zeros((n, 1), np.float32))


def lettered(text: str) -> bool:
    """Whether a text has a letter (category L; fractions, circled numbers and number
    letters are none)."""
    return any(map(str.isalpha, text))


def windows_of(data: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) of a text's bytes, padded."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


def _states(model: GruModel, side: int, steps: np.ndarray):
    """Run one direction over ``steps`` (time, batch); yields for each step what
    backpropagation needs, the new state last."""
    h = HIDDEN
    state = np.zeros((h, steps.shape[1]), np.float32)
    order = range(len(steps)) if side == 0 else range(len(steps) - 1, -1, -1)
    for t in order:
        xs, us = model.x[side].take(steps[t], axis=1), model.u[side] @ state
        pre = xs[: 2 * h] + us[: 2 * h]
        gates = _gate(pre)
        z, r = gates[:h], gates[h:]
        raw = xs[2 * h :] + r * us[2 * h :]
        cand = np.clip(raw, -1, 1)
        before, state = state, cand + z * (state - cand)
        yield t, before, us[2 * h :], z, r, raw, cand, state


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=-2, keepdims=True))
    return p / p.sum(axis=-2, keepdims=True)


def probabilities(model: GruModel, windows: np.ndarray) -> np.ndarray:
    """(windows, langs): the sum of the position probabilities in each window."""
    h, total = HIDDEN, np.zeros((len(windows), len(model.langs)), np.float32)
    for i in range(0, len(windows), _BATCH):
        steps = np.ascontiguousarray(windows[i : i + _BATCH].T).astype(np.intp)
        logits = np.empty((WINDOW, len(model.langs), steps.shape[1]), np.float32)
        for t, *_, state in _states(model, 0, steps):
            np.matmul(model.out[:, :h], state, out=logits[t])
        sums = np.zeros((len(model.langs), steps.shape[1]), np.float32)
        for t, *_, state in _states(model, 1, steps):
            sums += _softmax(logits[t] + model.out[:, h:] @ state + model.bias) * (steps[t] != PAD)
        total[i : i + _BATCH] = sums.T
    return total


def gradients(model: GruModel, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over positions and its gradient in every parameter, by
    backpropagation through time."""
    h, n = HIDDEN, len(model.langs)
    steps = np.ascontiguousarray(windows.T).astype(np.intp)
    real = (steps != PAD).astype(np.float32)
    tape = [list(_states(model, side, steps)) for side in (0, 1)]
    states = np.zeros((WINDOW, 2 * h, steps.shape[1]), np.float32)
    for side in (0, 1):
        for t, *_, state in tape[side]:
            states[t, side * h : (side + 1) * h] = state
    p = _softmax(np.matmul(model.out, states) + model.bias)
    count = max(real.sum(), 1.0)
    picked = np.take_along_axis(p, np.broadcast_to(labels[None, None, :], (WINDOW, 1, len(labels))), 1)[:, 0]
    loss = float(-(np.log(np.maximum(picked, 1e-9)) * real).sum() / count)
    d = (p - np.eye(n, dtype=np.float32)[labels].T) * (real / count)[:, None, :]
    g_out, g_bias = np.einsum("tnb,thb->nh", d, states), d.sum(axis=(0, 2))[:, None]
    d_states = np.matmul(model.out.T, d)
    g_x, g_u = [np.zeros_like(x) for x in model.x], [np.zeros_like(u) for u in model.u]
    for side in (0, 1):
        carry = np.zeros((h, steps.shape[1]), np.float32)
        columns = np.zeros((PAD + 1, 3 * h), np.float32)
        for t, before, un, z, r, raw, cand, _ in reversed(tape[side]):
            ds = carry + d_states[t, side * h : (side + 1) * h]
            dc = ds * (1 - z) * (np.abs(raw) < 1)
            dz, dr = ds * (before - cand) * 0.25 * ((z > 0) & (z < 1)), dc * un * 0.25 * ((r > 0) & (r < 1))
            du = np.concatenate([dz, dr, dc * r])
            np.add.at(columns, steps[t], np.concatenate([dz, dr, dc]).T)
            g_u[side] += du @ before.T
            carry = ds * z + model.u[side].T @ du
        g_x[side] = columns.T
    return loss, [*g_x, *g_u, g_out, g_bias]


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], rounds: int = 400, batch: int = 256, rate: float = 0.02, seed: int = 5) -> GruModel:
    """Adam on batches with as many windows of each language as of any other."""
    model, r = new_model(langs, seed), np.random.default_rng(seed)
    by = [np.flatnonzero(labels == k) for k in range(len(langs))]
    first, second = ([np.zeros_like(p) for p in model.parameters()] for _ in range(2))
    for step in range(1, rounds + 1):
        k = r.integers(0, len(langs), batch)
        at = np.array([by[c][r.integers(len(by[c]))] for c in k])
        _, grads = gradients(model, windows[at], labels[at])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, 3 * (1 - step / (rounds + 1)))
        for p, g, m, v in zip(model.parameters(), grads, first, second, strict=True):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def fit(docs: DataFrame, per_lang: int = 400, windows: int = 8, rounds: int = 400, max_langs: int = 500) -> GruModel | None:
    """Learn from about ``per_lang`` documents of each language in ``docs``, of the
    ``max_langs`` that have most documents (ties: by name)."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), "text", F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(1 << 30)).alias("draw"))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, per_lang / sizes[k]) * (1 << 30)))])
    picked = known.where(F.col("lang").isin(langs)).where(F.col("draw") < F.element_at(share, F.col("lang"))).select("lang", "text", "draw")

    def cut(batches):
        for batch in batches:
            for part in slices(batch, 1):
                found = []
                for text, draw in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    w = windows_of(np.frombuffer(text.encode("utf-8", "replace"), np.uint8)) if lettered(text) else np.zeros((0, WINDOW), np.int16)
                    found.append(w[np.random.default_rng(draw).permutation(len(w))[:windows]].tobytes())
                yield pa.RecordBatch.from_pydict({"lang": part.column(0), "found": pa.array(found, pa.binary())})

    rows = picked.mapInArrow(cut, "lang string, found binary").distinct().orderBy("lang", "found").collect()
    cuts = [np.frombuffer(r.found, np.int16).reshape(-1, WINDOW) for r in rows]
    langs = sorted({r.lang for r, c in zip(rows, cuts, strict=True) if len(c)})
    if not langs:
        return None
    x = np.concatenate([c for c in cuts if len(c)])
    y = np.concatenate([np.full(len(c), langs.index(r.lang)) for r, c in zip(rows, cuts, strict=True) if len(c)])
    return train(x, y, langs, rounds)


def predict(docs: DataFrame, model: GruModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from ``text`` alone."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                texts = part.column(1).to_pylist()
                named, score = ["und"] * len(texts), np.zeros(len(texts))
                read = [i for i, t in enumerate(texts) if model is not None and t and lettered(t)]
                if read:
                    data = [np.frombuffer(texts[i].encode("utf-8", "replace"), np.uint8) for i in read]
                    cuts = [windows_of(d) for d in data]
                    starts = np.cumsum([0, *(len(c) for c in cuts[:-1])])
                    sums = np.add.reduceat(probabilities(model, np.concatenate(cuts)).astype(float), starts, axis=0)
                    for i, p, d in zip(read, sums, data, strict=True):
                        k = int(np.argmax(p))
                        named[i], score[i] = model.langs[k], min(1.0, p[k] / len(d))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(named, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on rows that are not held out (crc32 of doc_id modulo 3 is not 1) and
    predict every row: doc_id, held_out, lang_pred, score."""
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out = predict(docs, fit(docs.where(~held)))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
