"""Document quality from a linear-chain conditional random field over lines.

Every line that is not blank has a state, bad or good. Its features are binned measurements of the line itself and of the
lines before and after it; weights are trained on a bounded sample of documents whose lines all take the document's label.
Forward-backward gives each line's marginal of good, and the mean over lines, weighted by length, is the document's quality.
A logistic curve, fitted on that sample under the classes' true weights, turns it into a probability.

Measurements need word counts of whole lines and no list of words, so that they hold in any language.

Defined cases: a null or empty text, or one of blank lines only, has no line and gets the sample's rate of label 1; rows are
scored one by one, repeated ones alike; without labels of both classes the score is 1; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import operator
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import sample_labels

PER_CLASS, LINES = 2500, 200  # of the training sample: documents of a class, lines of a document
BINS, STEPS, RATE, DECAY = 8, 120, 0.08, 2e-4
CELLS = 1 << 18  # lines and padding that forward-backward handles at once
_UPPER, _LOWER, _DIGIT = string.ascii_uppercase.encode(), string.ascii_lowercase.encode(), string.digits.encode()
_PLAIN = b" \t.,;:'\"()?-\r"
_SYMBOL = bytes(b for b in string.punctuation.encode() if b not in _PLAIN)
NAMES = ("length", "words", "upper", "symbol", "digit", "distinct", "repeats", "word length", "longest word", "symbol ends", "seen before", "ends sentence", "short words")


def lines_of(text: str | None) -> list[bytes]:
    return [x for x in (text or "").encode("utf-8", "replace").split(b"\n") if x.strip()]


def measure(lines: list[bytes]) -> np.ndarray:
    """A row of ``NAMES`` for each line."""
    out = np.empty((len(lines), len(NAMES)))
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        n = len(line)
        words = line.split()
        sizes = list(map(len, words))
        k = len(words)
        upper, lower = n - len(line.translate(None, _UPPER)), n - len(line.translate(None, _LOWER))
        ends = sum(1 for w in words if w[-1] in _SYMBOL)
        out[i] = (
            np.log2(n), np.log2(k), upper / max(1, upper + lower), (n - len(line.translate(None, _SYMBOL))) / n, (n - len(line.translate(None, _DIGIT))) / n,
            len(set(words)) / k, sum(map(operator.eq, words, words[1:])) / k, sum(sizes) / k, max(sizes), ends / k, line in seen, line.rstrip()[-1:] in (b".", b"!", b"?"), sum(1 for s in sizes if s <= 3) / k,
        )
        seen.add(line)
    return out


class Field:
    """The trained field and the curve after it."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        self.width = BINS + 2  # bins, and one for a neighbour that is not there
        self.weights = np.zeros(3 * len(NAMES) * self.width)
        self.moves = np.zeros((2, 2))
        self.curve, self.empty = (1.0, 0.0), 1.0

    def places(self, measured: np.ndarray) -> np.ndarray:
        """Indices into the weights: for each line its own bins, those of the line before and of the line after."""
        n = len(measured)
        own = np.stack([np.searchsorted(e, measured[:, j], "left") for j, e in enumerate(self.edges)], axis=1) if n else np.empty((0, len(NAMES)), int)
        none = np.full((1, len(NAMES)), self.width - 1)
        padded = np.concatenate([none, own, none])
        base = np.arange(len(NAMES)) * self.width
        size = len(NAMES) * self.width
        return np.concatenate([padded[1:-1] + base, padded[:n] + base + size, padded[2:] + base + 2 * size], axis=1)

    def marginals(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Of each document's lines the probability of good, given the lines' scores for good against bad."""
        out: list[np.ndarray] = [np.empty(0)] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(scores[order[end]]) * (end + 1 - at) <= CELLS:
                end += 1
            ids = order[at:end]
            p, _, _ = self.forward_backward(*pad([scores[i] for i in ids]))
            for row, i in enumerate(ids):
                out[i] = p[row, : len(scores[i])]
            at = end
        return out

    def forward_backward(self, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of good, expected moves between states and log-partition of padded documents."""
        rows, length = scores.shape
        move = np.exp(self.moves)
        emit = np.exp(np.stack([-np.maximum(scores, 0), np.minimum(scores, 0)], axis=2))  # scaled so that the larger is 1
        ahead, back = np.empty((rows, length, 2)), np.ones((rows, length, 2))
        scale = np.zeros(rows)
        for t in range(length):
            f = emit[:, t] if t == 0 else (ahead[:, t - 1] @ move) * emit[:, t]
            total = f.sum(axis=1, keepdims=True)
            ahead[:, t] = f / total
            scale += np.where(t < sizes, np.log(total[:, 0]) + np.maximum(scores[:, t], 0), 0)
        for t in range(length - 2, -1, -1):
            b = (back[:, t + 1] * emit[:, t + 1]) @ move.T
            back[:, t] = np.where((t + 1 < sizes)[:, None], b / b.sum(axis=1, keepdims=True), 1.0)
        both = ahead * back
        both /= both.sum(axis=2, keepdims=True)
        moves = np.zeros((2, 2))
        if length > 1:
            pair = ahead[:, :-1, :, None] * move * (emit * back)[:, 1:, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            moves = (pair * (np.arange(1, length) < sizes[:, None])[:, :, None, None]).sum(axis=(0, 1))
        return both[:, :, 1], moves, scale

    def quality(self, texts: list[str | None]) -> np.ndarray:
        lines = [lines_of(t) for t in texts]
        found = self.marginals([self.weights[self.places(measure(x))].sum(axis=1) for x in lines])
        raw = np.array([np.average(p, weights=list(map(len, x))) if x else np.nan for p, x in zip(found, lines, strict=True)])
        return raw

    def score(self, texts: list[str | None]) -> np.ndarray:
        raw = self.quality(texts)
        return np.where(np.isnan(raw), self.empty, 1 / (1 + np.exp(-(self.curve[0] * odds(raw) + self.curve[1]))))


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(np.nan_to_num(p, nan=0.5), 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def pad(scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in scores])
    out = np.zeros((len(scores), max(1, sizes.max())))
    for i, s in enumerate(scores):
        out[i, : len(s)] = s
    return out, sizes


def fit(measured: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, texts_sizes: list[np.ndarray]) -> Field:
    """Conditional likelihood of the labels by Adam, then the curve by Newton steps."""
    rows = np.concatenate([m for m in measured if len(m)])
    field = Field([np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(len(NAMES))])
    places = [field.places(m) for m in measured]
    full = [i for i in range(len(measured)) if len(measured[i])]
    full.sort(key=lambda i: len(measured[i]))
    batches, at = [], 0
    while at < len(full):
        end = at + 1
        while end < len(full) and len(measured[full[end]]) * (end + 1 - at) <= CELLS:
            end += 1
        batches.append(full[at:end])
        at = end
    n_lines = sum(len(measured[i]) for i in full)
    theta = [field.weights, field.moves]
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for step in range(1, STEPS + 1):
        grads = [np.zeros_like(x) for x in theta]
        for ids in batches:
            scores = [field.weights[places[i]].sum(axis=1) for i in ids]
            p, moves, _ = field.forward_backward(*pad(scores))
            for row, i in enumerate(ids):
                miss = labels[i] - p[row, : len(scores[row])]
                grads[0] += np.bincount(places[i].ravel(), np.repeat(miss, places[i].shape[1]), len(field.weights))
            stay = np.zeros((2, 2))
            for i in ids:
                stay[labels[i], labels[i]] += len(measured[i]) - 1
            grads[1] += stay - moves
        for k, x in enumerate(theta):
            g = grads[k] / n_lines - DECAY * x
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            x += RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    found = field.marginals([field.weights[p].sum(axis=1) for p in places])
    raw = np.array([np.average(p, weights=s) if len(p) else np.nan for p, s in zip(found, texts_sizes, strict=True)])
    used = ~np.isnan(raw)
    x, y, w = odds(raw[used]), labels[used].astype(float), weights[used]
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (y - p) * x).sum() - 1e-3 * a, (w * (y - p)).sum()])
        h = w * p * (1 - p) + 1e-9
        step = np.linalg.solve([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum()]], g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -2, 2)
    field.curve = float(max(a, 0.01)), float(b)
    field.empty = float(np.average(labels, weights=weights))
    return field


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, lines: int = LINES) -> Field | None:
    """A field of ``labels`` (doc_id, label 0 or 1 in column quality) on ``docs`` (doc_id, text).

    The sample is bounded: about ``per_class`` documents of a class, evenly spread ``lines`` of the longer ones. Only
    measurements reach the driver. None without both labels.
    """
    sample, weight = sample_labels(labels, "quality", per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(2):
                x = lines_of(t.as_py())
                m = measure(x)
                if len(x) > lines:
                    at = np.linspace(0, len(x) - 1, lines).astype(int)
                    x, m = [x[i] for i in at], m[at]
                out.append((m.astype(np.float32).tobytes(), np.array(list(map(len, x)), np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([m for m, _ in out], pa.binary()), pa.array([s for _, s in out], pa.binary())], names=["doc_id", "label", "m", "s"])

    examples = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    rows = sorted(examples.mapInArrow(run, "doc_id bigint, label int, m binary, s binary").collect(), key=lambda r: (r["doc_id"], r["label"], r["m"]))
    y = np.array([r["label"] for r in rows], int)
    if len(set(y.tolist())) < 2:
        return None
    measured = [np.frombuffer(r["m"], np.float32).reshape(-1, len(NAMES)).astype(float) for r in rows]
    return fit(measured, y, np.array([weight[k] for k in y.tolist()]), [np.frombuffer(r["s"], np.int32) for r in rows])


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` (text, ..) with its text replaced by score."""
    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema.fields), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = field.score(part.column(0).to_pylist()) if field is not None else np.ones(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, pa.float64())], names=[*others, "score"])

    return docs.select("text", *others).mapInArrow(run, schema)
