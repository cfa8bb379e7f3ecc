"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words of the labelled sample; a term's weight in a text is ``(1 + log n) * idf * (FLOOR + phi)``. Document
frequencies are counted over all documents, and phi, the correlation of a term with the label among the examples, scales
every term and drops none. Examples with equal counts are one entry of the index with their votes added.

The postings of a term are cut into blocks of ``BLOCK`` entries, each with its greatest weight. The sum of these over a
query's terms bounds the cosines of a block. Blocks are read in the order of their bounds, ``FIRST``
of them and then all whose bound reaches the k-th best cosine so far, so that the k nearest are exact; of equal ones the first
example counts.

The share of label 1 among the votes, weighted by class and a power of the cosine and shrunk towards the share among all
examples, becomes ``score`` by a logistic curve fitted on the examples, each judged by all others. ``evidence`` names the
nearest examples.

Bounds: about ``PER_CLASS`` examples of each class, drawn by a hash of the id and read whole, reach the driver, which holds their
counts in flat arrays and never as Python objects of their own; what can be derived from the postings is not sent to the tasks.

Defined cases: null and empty texts, and texts that share no word with an example, get the share of label 1 among the
examples and no evidence; rows are scored one by one, repeated ones alike; without labels the score is 0, with one class
only it is that class; an empty table gives no rows; other columns are kept, those named ``score`` or ``evidence`` replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import repeat
from math import log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD, sample_labels

FLOOR = 0.01
PER_CLASS = 2000
#: Terms by which the entries of the index are arranged.
COMMON = 2048
BLOCK, FIRST, NEAREST, POWER, PRIOR = 64, 2, 20, 2.0, 0.5
_WORDS = re.compile(WORD.replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60"))


def term_counts(text: str | None) -> Counter:
    """All terms of a text and how often they occur."""
    return Counter(_WORDS.findall((text or "").lower()))


class Vocabulary:
    """The terms of the examples and their places."""

    def __init__(self, terms: pa.StringArray):
        self.terms = terms

    @property
    def kept(self) -> list[str]:
        return self.terms.to_numpy(zero_copy_only=False).tolist()

    @cached_property
    def places(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.kept)}

    def __getstate__(self) -> dict:
        return {"terms": self.terms}

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text's known terms, ascending, and how often they occur."""
        found = term_counts(text)
        terms = np.fromiter(map(self.places.get, found, repeat(-1)), np.int64, len(found))
        counts = np.fromiter(found.values(), np.int64, len(found))
        order = np.argsort(terms)
        order = order[np.count_nonzero(terms < 0) :]
        return terms[order], counts[order]

    def present(self, text: str | None) -> np.ndarray:
        """Places of the text's known terms, and -1 where it has others."""
        found = set(_WORDS.findall((text or "").lower()))
        return np.fromiter(map(self.places.get, found, repeat(-1)), np.int64, len(found))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - ends + sizes, sizes)
    out += np.arange(len(out))
    return out


def _alike(term: np.ndarray, weight: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """An order of the vectors in which alike ones are neighbours, so that blocks differ in their maxima.

    Halved again and again, down to ``BLOCK``, along the direction in which they differ most. Only the first ``COMMON`` terms
    (``train`` numbers frequent ones first) count here; the order decides what is read, never what is found.
    """
    n, common = len(cuts) - 1, term < COMMON
    starts = np.concatenate([[0], np.cumsum(common)])[cuts]
    term, weight = term[common], weight[common]
    todo, out = [np.arange(n)], [np.empty(0, np.int64)]
    while todo:
        at = todo.pop()
        if len(at) <= BLOCK:
            out.append(at)
            continue
        # x, the vectors less their mean, stays a product of sparse rows, as a dense one would take more room than the index
        sizes = starts[at + 1] - starts[at]
        own, row = _spread(starts[at], sizes), np.repeat(np.arange(len(at)), sizes)
        t, w = term[own].astype(np.int64), weight[own]
        mean = np.bincount(t, w, COMMON) / len(at)
        far = int(np.argmax(np.bincount(row, w * (w - 2 * mean[t]), len(at))))
        along = np.bincount(t[row == far], w[row == far], COMMON) - mean
        for _ in range(12):
            x = np.bincount(row, w * along[t], len(at)) - mean @ along
            along = np.bincount(t, w * x[row], COMMON) - mean * x.sum()
            along /= max(float(np.linalg.norm(along)), 1e-30)
        at = at[np.argsort(-np.round(np.bincount(row, w * along[t], len(at)) - mean @ along, 9), kind="stable")]
        half = -(-(len(at) // 2) // BLOCK) * BLOCK
        todo += [at[half:], at[:half]]
    return np.concatenate(out)


class Index:
    """Distinct example vectors with their votes: sparse postings of each term, by blocks, and the blocks' maxima."""

    def __init__(self, vectors: Iterable[dict[int, float] | tuple[np.ndarray, np.ndarray]], votes: list[tuple[float, float]], names: list[int], size: int):
        pairs = [(np.fromiter(v, np.int64, len(v)), np.fromiter(v.values(), float, len(v))) if isinstance(v, dict) else v for v in vectors]
        term = np.concatenate([np.empty(0, np.int32), *(t for t, _ in pairs)])
        weight = np.concatenate([np.empty(0), *(w for _, w in pairs)])
        lengths = np.array([len(t) for t, _ in pairs], np.int64)
        del pairs
        order = _alike(term, weight, np.cumsum([0, *lengths]))
        self.given = order  # the places in ``vectors``, which decide between equal cosines
        self.votes = np.array([votes[i] for i in order], float).reshape(-1, 2)
        self.names = [names[i] for i in order]
        place = np.repeat(np.argsort(order).astype(np.int32), lengths)
        by_term = np.lexsort((place, term))
        self.place, self.weight = place[by_term].astype(np.int64), weight[by_term]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=size))])
        self._cut()

    def _cut(self) -> None:
        """The blocks and runs of the postings. A run is the postings of one term in one block."""
        self.blocks = -(-len(self.given) // BLOCK)
        size, block = len(self.starts) - 1, (self.place // BLOCK).astype(np.int32)
        term = np.repeat(np.arange(size, dtype=np.int32), np.diff(self.starts))
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])[: len(term)])
        self.first, self.length = first, np.diff(np.r_[first, len(term)])
        self.block = block[first].astype(np.int64)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.runs = np.searchsorted(term[first], np.arange(size + 1))
        self.least_vote = float(self.votes.sum(axis=1).min()) if len(self.votes) else 0.0

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("given", "votes", "names", "weight", "starts")} | {"place": self.place.astype(np.int32)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.place = self.place.astype(np.int64)
        self._cut()

    def nearest(self, query: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``search``."""
        return self.search(np.fromiter(query, np.int64, len(query)), np.fromiter(query.values(), float, len(query)), k)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k entries with the greatest positive cosine; of equal ones those given first."""
        places, cosines = np.empty(0, np.int64), np.empty(0)
        if not len(terms) or not self.blocks:
            return places, cosines
        sizes = self.runs[terms + 1] - self.runs[terms]
        runs, by_run = _spread(self.runs[terms], sizes), np.repeat(weights, sizes)
        blocks = self.block.take(runs)
        bounds, held = np.bincount(blocks, by_run * self.most.take(runs), self.blocks), np.bincount(blocks, minlength=self.blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        wanted = np.zeros(self.blocks, bool)
        for part in (order[:FIRST], order[FIRST:]):
            if len(places) >= k:
                part = part[bounds[part] >= cosines[k - 1] - 1e-9]
            if not len(part):
                break
            wanted[:] = False
            wanted[part] = True
            if 1.4 * held[part].sum() > len(blocks):
                # most of the postings are needed: read them term by term, and leave out the other blocks' sums
                starts, ends = self.starts[terms], self.starts[terms + 1]
                cuts = [slice(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                products = np.concatenate([self.weight[c] for c in cuts])
                products *= np.repeat(weights, ends - starts)
                dots = np.bincount(np.concatenate([self.place[c] for c in cuts]), products)
                found = np.flatnonzero(dots)
                found = found[wanted[found // BLOCK]]
            else:
                own = np.flatnonzero(wanted[blocks])
                lengths = self.length[runs[own]]
                postings = _spread(self.first[runs[own]], lengths)
                dots = np.bincount(self.place.take(postings), np.repeat(by_run[own], lengths) * self.weight.take(postings))
                found = np.flatnonzero(dots)
            if len(found) > k:
                values = dots[found]
                found = found[values >= np.partition(values, len(values) - k)[len(values) - k]]
            places, cosines = np.concatenate([places, found]), np.concatenate([cosines, dots[found]])
            best = np.lexsort((self.given[places], -cosines))[:k]
            places, cosines = places[best], cosines[best]
        return places, cosines


class Model:
    """Vocabulary, term weights, index, share of label 1, and the curve from shares of votes to scores."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, index: Index | None, rate: float):
        self.vocabulary, self.weights, self.index, self.rate = vocabulary, weights, index, rate
        self.curve = (0.0, 1.0)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of the terms, of norm 1."""
        raw = (1 + np.log(counts)) * self.weights[terms]
        return raw / sqrt(raw @ raw) if len(raw) else raw

    def _share(self, cosines: np.ndarray, votes: np.ndarray) -> float:
        for_, against = np.minimum(cosines, 1.0) ** POWER @ votes
        shrink = PRIOR * self.index.least_vote * float(cosines[0]) ** POWER
        value = (for_ + shrink * self.rate) / (for_ + against + shrink)
        return log(value / (1 - value))

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray, int, int, float]]) -> None:
        """The curve from (terms, counts, entry, label, weight) of the examples, each judged without its own vote."""
        x, y, w = [], [], []
        for terms, counts, entry, label, weight in examples:
            places, cosines = self.index.search(terms, self.vector(terms, counts), NEAREST + 1)
            votes = self.index.votes[places]
            votes[places == entry, 1 - label] -= weight
            good = votes.sum(axis=1) > 1e-9 * weight
            if good.any():
                x.append(self._share(cosines[good][:NEAREST], votes[good][:NEAREST]))
                y.append(label)
                w.append(weight)
        if len(set(y)) == 2:
            self.curve = _logistic(np.array(x), np.array(y, float), np.array(w))

    def score(self, text: str | None) -> tuple[float, list[int]]:
        terms, counts = self.vocabulary.counts(text)
        if not len(terms) or self.index is None:
            return self.rate, []
        places, cosines = self.index.search(terms, self.vector(terms, counts), NEAREST)
        if not len(places):
            return self.rate, []
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * self._share(cosines, self.index.votes[places]), -30, 30)))), [self.index.names[i] for i in places[:3]]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Intercept and slope of a weighted logistic curve, by Newton's method; the ridge draws the slope to 1."""
    w = w / w.mean()
    z, theta = np.stack([np.ones_like(x), x], axis=1), np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        gradient = z.T @ (w * (y - p)) - ridge * (theta - [0.0, 1.0])
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), gradient)
        theta = theta + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(max(theta[1], 1e-3))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of ``labels`` (doc_id, label 0 or 1 in column toxic) on the texts of ``docs`` (doc_id, text)."""
    sample, weight = sample_labels(labels, "toxic", per_class)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = [term_counts(t.as_py()) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], names=["doc_id", "label", "terms", "counts"])

    examples = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    found = examples.mapInArrow(terms, "doc_id bigint, label int, terms array<string>, counts array<int>").toArrow()
    ids, label = found["doc_id"].to_pylist(), found["label"].to_pylist()
    n = [label.count(k) for k in (0, 1)]
    vocabulary, counts = _counted(found)
    del found
    if not all(n):
        return Model(vocabulary, np.empty(0), None, float(bool(n[1])))
    size = len(vocabulary.terms)
    keys = [t.tobytes() + c.tobytes() for t, c in counts]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], label[i], keys[i]))
    holds = np.zeros((2, size))
    for i in order:
        holds[label[i], counts[i][0]] += 1
    b, a = holds
    phi = np.abs(a * n[0] - b * n[1]) / np.sqrt((a + b) * np.maximum(sum(n) - a - b, 1) * n[0] * n[1])
    total, df = _frequencies(docs, vocabulary)
    weights = (np.log((1 + total) / (1 + df)) + 1) * (FLOOR + phi)
    model = Model(vocabulary, weights, None, n[1] * weight[1] / (n[0] * weight[0] + n[1] * weight[1]))
    entries: dict[bytes, list] = {}
    for i in order:
        if keys[i]:
            entry = entries.setdefault(keys[i], [0.0, 0.0, ids[i], counts[i]])
            entry[1 - label[i]] += weight[label[i]]
    if not entries:
        return model
    vectors = ((v[3][0], model.vector(*v[3])) for v in entries.values())
    model.index = Index(vectors, [(v[0], v[1]) for v in entries.values()], [v[2] for v in entries.values()], size)
    at = {name: i for i, name in enumerate(model.index.names)}
    model.fit([(*counts[i], at[entries[keys[i]][2]], label[i], weight[label[i]]) for i in order if keys[i]])
    return model


def _counted(found: pa.Table) -> tuple[Vocabulary, list[tuple[np.ndarray, np.ndarray]]]:
    """The vocabulary of the rows (terms, counts), and of each row the places of its terms, ascending, and their counts."""
    words = pc.list_flatten(found["terms"])
    known = pc.value_counts(words)
    known = pa.table({"term": known.field("values"), "n": known.field("counts")})
    # frequent terms first: what most texts look up and read then lies together in memory
    kept = known["term"].take(pc.sort_indices(known, [("n", "descending"), ("term", "ascending")])).combine_chunks()
    vocabulary = Vocabulary(kept if isinstance(kept, pa.Array) else pa.concat_arrays([pa.array([], kept.type), *kept.chunks]))
    places = np.concatenate([np.empty(0, np.int32), *(c.to_numpy(zero_copy_only=False) for c in pc.index_in(words, value_set=vocabulary.terms).chunks)])
    times = np.concatenate([np.empty(0, np.int32), *(c.to_numpy(zero_copy_only=False) for c in pc.list_flatten(found["counts"]).chunks)])
    cuts, out = np.cumsum([0, *pc.list_value_length(found["terms"]).to_pylist()]).tolist(), []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        by_place = a + np.argsort(places[a:b])
        places[a:b], times[a:b] = places[by_place], times[by_place]
        out.append((places[a:b], times[a:b]))
    return vocabulary, out


def _frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Number of all rows of ``docs``, and of those that hold each term; one count a term and task is shuffled."""
    size = len(vocabulary.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size + 2, np.int64)  # the last place takes the terms that no example has
        for batch in batches:
            found[size] += batch.num_rows
            for t in batch.column(0):
                found[vocabulary.present(t.as_py())] += 1
        found = found[:-1]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some])], names=["term", "n"])

    out = np.zeros(size + 1)
    for r in docs.select("text").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[r["term"].to_numpy()] = r["n"].to_numpy()
    return int(out[size]), out[:size]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text, ..) with its text replaced by score and evidence (doc_ids of the nearest examples)."""
    others = [c for c in docs.columns if c not in ("text", "score", "evidence")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema.fields), "score double, evidence array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t.as_py()) for t in batch.column(0)]
            columns = [*batch.columns[1:], pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "score", "evidence"])

    return docs.select("text", *others).mapInArrow(run, schema)
