"""Language identification with a bidirectional gated recurrent network over bytes.

Texts are UTF-8 bytes, cut into windows of a fixed length that are run side by side. In each window a forward and a
backward recurrence read the bytes, every position gets language probabilities from the two states that meet there, and
a document's probabilities are the mean over its positions that hold letters. Each recurrence starts some bytes before
the window that it reads, so a position never meets a state that knows nothing. Trained in numpy by backpropagation
through time on the driver, from a bounded sample; run in numpy over Arrow batches, every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import text_slices

#: Bounds of the training sample: documents, shared evenly by the languages (one of each at least), and characters of each, at a place that its hash chooses.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 300
#: Leading bits of the hashes whose values are counted.
SAMPLE_BITS = 10
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Bytes that hold letters: ASCII letters and all parts of longer characters.
_MASK = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)], np.float32)


@dataclass
class Model:
    """embed (2, 256, 3H), recur (2, H, 3H), out (2, H, C), bias (C); gates in the order reset, update, new."""

    languages: list[str]
    embed: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray


# The squashing functions are rational, x / (1 + |x|) and its half plus a half: as good here as tanh and the logistic
# function, and a fraction of their cost. Slopes: (1 - |s|)^2 and twice the square of min(g, 1 - g).
def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * _squash(x)


def _gate_slope(g: np.ndarray) -> np.ndarray:
    return 2 * np.minimum(g, 1 - g) ** 2


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the letters of x (T, B), windows of languages y (B), and its gradient by every parameter."""
    (window, batch), h = x.shape, p["recur"].shape[1]
    dirs = np.arange(2)[:, None]
    both = np.stack([x, x[::-1]], axis=1)  # (T, 2, B)
    hs = np.zeros((window + 1, 2, batch, h), p["recur"].dtype)
    kept = []
    for t in range(window):
        e, a = p["embed"][dirs, both[t]], hs[t] @ p["recur"]
        r, z = _gate(e[..., :h] + a[..., :h]), _gate(e[..., h : 2 * h] + a[..., h : 2 * h])
        n = _squash(e[..., 2 * h :] + r * a[..., 2 * h :])
        hs[t + 1] = n + z * (hs[t] - n)
        kept.append((r, z, n, a[..., 2 * h :]))
    forward, backward = hs[1:, 0], hs[1:, 1][::-1]
    logits = forward @ p["out"][0] + backward @ p["out"][1] + p["bias"]
    prob = np.exp(logits - logits.max(-1, keepdims=True))
    prob /= prob.sum(-1, keepdims=True)
    weight = _MASK[x]
    weight = weight / max(1.0, weight.sum())
    loss = -float((np.log(prob[:, np.arange(batch), y] + 1e-30) * weight).sum())
    prob[:, np.arange(batch), y] -= 1
    d_logits = prob * weight[..., None]
    grad = {"bias": d_logits.sum((0, 1)), "out": np.stack([np.einsum("tbh,tbc->hc", s, d_logits) for s in (forward, backward)])}
    d_states = np.stack([d_logits @ p["out"][0].T, (d_logits @ p["out"][1].T)[::-1]], axis=1)
    d_h, d_embed, d_recur = np.zeros_like(hs[0]), [], np.zeros_like(p["recur"])
    for t in reversed(range(window)):
        r, z, n, a_n = kept[t]
        d_h = d_h + d_states[t]
        d_n = d_h * (1 - z) * (1 - np.abs(n)) ** 2
        d_z = d_h * (hs[t] - n) * _gate_slope(z)
        d_r = d_n * a_n * _gate_slope(r)
        d_a = np.concatenate([d_r, d_z, d_n * r], -1)
        d_embed.append(np.concatenate([d_r, d_z, d_n], -1))
        d_recur += hs[t].transpose(0, 2, 1) @ d_a
        d_h = d_h * z + d_a @ p["recur"].transpose(0, 2, 1)
    flat = np.stack(d_embed[::-1])  # (T, 2, B, 3H)
    at = (both.astype(np.int64) + 256 * np.arange(2)[None, :, None])[..., None] * (3 * h) + np.arange(3 * h)
    grad["embed"] = np.bincount(at.ravel(), flat.ravel(), 512 * 3 * h).reshape(2, 256, 3 * h)
    grad["recur"] = d_recur
    return loss, grad


def train(texts: list[str], labels: list[str], hidden: int = 8, window: int = 48, batch: int = 192, steps: int = 350, rate: float = 0.02, seed: int = 5) -> Model:
    """Fit by Adam on windows of the texts; languages are drawn evenly, so a rare one is learned as well as a common one."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    h, c = hidden, len(languages)
    p = {
        "embed": rng.normal(0, 0.3, (2, 256, 3 * h)),
        "recur": rng.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)),
        "out": rng.normal(0, 1 / np.sqrt(h), (2, h, c)),
        "bias": np.zeros(c),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    model = Model(languages, **p)
    by_language = [[t.encode() for t, x in zip(texts, labels) if x == lang and _LETTER.search(t)] for lang in languages]
    by_language = [(i, x) for i, x in enumerate(by_language) if x]
    if c < 2 or not by_language:
        return model
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        x, y = np.zeros((window, batch), np.uint8), np.zeros(batch, np.int64)
        for j in range(batch):
            y[j], own = by_language[rng.integers(len(by_language))]
            t = own[rng.integers(len(own))]
            a = int(rng.integers(max(1, len(t) - window + 1)))
            part = np.frombuffer(t[a : a + window], np.uint8)
            x[: len(part), j] = part
        _, grad = gradients(p, x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        lr = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] -= (lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, **p)


class Scorer:
    """Runs a model over many windows at once, a feature to a row of contiguous values.

    A window is read with `margin` bytes more on either side, which only bring the state up; before and after a text the
    state stays zero.
    """

    def __init__(self, model: Model, window: int = 96, block: int = 2048, margin: int = 16):
        self.model, self.window, self.block, self.margin = model, window, block, margin
        self.h = model.recur.shape[1]
        self.embed = np.ascontiguousarray(model.embed.transpose(0, 2, 1))
        self.recur = np.ascontiguousarray(model.recur.transpose(0, 2, 1))

    def _states(self, x: np.ndarray, d: int) -> np.ndarray:
        """x (margin + T, B) in reading order -> states (T, H, B)."""
        h, (steps, n) = self.h, x.shape
        out, e, a, size = np.empty((steps, h, n), np.float32), *(np.empty((3 * h, n), np.float32) for _ in range(3))
        state = np.zeros((h, n), np.float32)
        gates, new, cand = e[: 2 * h], e[2 * h :], a[2 * h :]
        table, recur = self.embed[d], self.recur[d]
        for t in range(steps):
            np.take(table, x[t], axis=1, out=e, mode="clip")
            np.matmul(recur, state, out=a)
            gates += a[: 2 * h]
            np.abs(gates, out=size[: 2 * h])
            size[: 2 * h] += 1
            gates /= size[: 2 * h]
            gates *= 0.5
            gates += 0.5
            cand *= gates[:h]
            cand += new
            np.abs(cand, out=size[:h])
            size[:h] += 1
            cand /= size[:h]
            nxt = out[t]
            np.subtract(state, cand, out=nxt)
            nxt *= gates[h:]
            nxt += cand
            if t < self.margin:
                nxt *= x[t] != 0
            state = nxt
        return out[self.margin :]

    def windows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x (N, margin + window + margin) bytes -> sums of probabilities over letters of the windows (N, C), letters (N)."""
        c, m = len(self.model.languages), self.margin
        sums, letters = np.zeros((len(x), c)), _MASK[x[:, m : m + self.window]].sum(1)
        for a in range(0, len(x), self.block):
            whole = np.ascontiguousarray(x[a : a + self.block].T)
            at, part = whole.astype(np.intp), whole[m : m + self.window]
            logits = np.matmul(self.model.out[0].T, self._states(at[: m + self.window], 0))
            logits += np.matmul(self.model.out[1].T, self._states(at[m:][::-1], 1))[::-1]
            logits += self.model.bias[:, None]
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            logits *= (_MASK[part] / logits.sum(1))[:, None]
            sums[a : a + self.block] = logits.sum(0).T
        return sums, letters

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        own = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not own or not self.model.languages:
            return found
        data = [texts[i].encode() for i in own]
        counts = np.array([-(-len(b) // self.window) for b in data])
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        m, w = self.margin, self.window
        x = np.zeros((int(counts.sum()), w + 2 * m), np.uint8)
        for b, s, n in zip(data, starts, counts):
            padded = np.zeros(n * w + 2 * m, np.uint8)
            padded[m : m + len(b)] = np.frombuffer(b, np.uint8)
            x[s : s + n] = np.lib.stride_tricks.sliding_window_view(padded, w + 2 * m)[::w]
        sums, letters = self.windows(x)
        pooled = np.add.reduceat(sums, starts, axis=0) / np.maximum(1.0, np.add.reduceat(letters, starts))[:, None]
        best = pooled.argmax(1)
        for i, k, row in zip(own, best, pooled):
            found[i] = (self.model.languages[k], float(min(1.0, row[k])))
        return found


def held_out() -> Column:
    """crc32 of doc_id as text, mod 4, is 2; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def shares(counts: dict[str, int], most: int) -> dict[str, int]:
    """How many rows each language gives: most, shared evenly; what a small one lacks goes to the others, and each gives one at least."""
    found, left = {}, most
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        found[lang] = min(n, max(1, left // (len(counts) - i)))
        left -= found[lang]
    return found


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Train on a bounded sample of the labelled rows that are not held out: of each language its share of sample_docs, smallest by a hash of doc_id and text.

    Hashes are counted by bucket first, so that little more than the sample is sent to the driver, whatever the number
    of tasks. Equal rows count once.
    """
    own = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    part = F.expr(f"substring(text, cast(1 + pmod(_hash, greatest(length(text) - {sample_chars}, 0) + 1) as int), {sample_chars})")
    hashes = own.select(hashed.alias("_hash"), "text", "lang")
    bucket = F.shiftright("_hash", 64 - SAMPLE_BITS)
    counts: dict[str, dict[int, int]] = {}
    for r in hashes.groupBy("lang", bucket.alias("bucket")).count().collect():
        counts.setdefault(r["lang"], {})[r["bucket"]] = r["count"]
    share = shares({lang: sum(c.values()) for lang, c in counts.items()}, sample_docs)
    last = []
    for lang, c in counts.items():
        so_far = 0
        for k in sorted(c):
            so_far += c[k]
            if so_far >= share[lang]:
                last.append((lang, k))
                break
    ends = F.broadcast(docs.sparkSession.createDataFrame(last, "_lang string, _last long"))
    near = hashes.join(ends, (F.col("lang") == F.col("_lang")) & (bucket <= F.col("_last")))
    rows = sorted(near.select("_hash", part.alias("text"), "lang").distinct().collect(), key=lambda r: (r["_hash"], r["text"], r["lang"]))
    left, texts, labels = dict(share), [], []
    for r in rows:
        if left[r["lang"]]:
            left[r["lang"]] -= 1
            texts.append(r["text"])
            labels.append(r["lang"])
    return train(texts, labels)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """documents (doc_id, text, lang) -> doc_id, held_out, lang_pred, score; a row per row of documents.

    Without a model one is fitted first. lang_pred is `und` with score 0 if the text is null or has no letter, or if
    there is nothing to learn from. Repeated rows give repeated results, an empty table an empty one; other columns are
    ignored, and lang is no input of a prediction.
    """
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in text_slices(batches, most=1 << 20):
            found = scorer.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = 0.0, model: Model | None = None) -> DataFrame:
    """The documents in a language that was learned, with their own columns: `und` and scores below `least` go.

    Null and empty texts and texts without a letter go; with nothing to learn from, all do. A null doc_id or lang is no
    reason to go. Repeated rows stay repeated; an empty table gives an empty result.
    """
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in text_slices(batches, most=1 << 20):
            yield b.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in scorer.score(b.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
