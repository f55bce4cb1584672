"""Quality classifier on subword embeddings: hashed vectors of words, word pairs and character n-grams, averaged per document.

Training is stochastic gradient descent in numpy on a bounded sample of labelled
rows, in one place. Scoring is distributed: as the document vector is a mean and the
output is linear before the softmax, each word carries one learned number per
class, and a document costs one lookup per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import CACHE_ENTRIES, map_texts, slices, words_of

#: Labelled rows used for training at most; those with the lowest hash of their id.
SAMPLE_ROWS = 3000
BUCKETS = 1 << 17
DIMENSIONS = 16
GRAMS = (3, 4, 5)
EPOCHS = 6
RATE = 0.5
SEED = 20
PAIR = np.uint64(0xD6E8FEB86659FD93)
BASE = np.uint64(0x9E3779B97F4A7C15)
RECENCY = [1, 8, 64, 512]


@dataclass
class Model:
    """``weights[b, c]``: what one occurrence of feature b adds to class c's sum; ``bias``: per class."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    classes: list

    def weights(self) -> np.ndarray:
        return (self.vectors @ self.output.T).astype(np.float64)


class Features:
    """Buckets of a text's words, their character n-grams, word pairs and word recency, with a bounded cache of words.

    All hashes are polynomials over mixed code points, made for many words at once.
    Recency says how far back the same word stood before (none, then by powers of
    eight), which is what sets looping text apart from prose with the same words.
    """

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.reset()

    def reset(self) -> None:
        self.words: dict[str, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((hashes * PAIR) >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)

    def _make(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, word number of each feature, bucket of each feature)."""
        codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        starts = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words)), lengths)
        left = (starts + lengths)[word] - np.arange(len(codes))  # characters from here to the word's end
        with np.errstate(over="ignore"):
            mixed = (codes + np.uint64(1)) * PAIR
            mixed ^= mixed >> np.uint64(31)
            powers = np.cumprod(np.full(int(lengths.max()), BASE, np.uint64))
            hashes = np.add.reduceat(mixed * powers[left - 1], starts)
            of, made, rolled = [np.arange(len(words))], [self.bucket(hashes)], mixed.copy()
            for n in range(2, max(GRAMS) + 1):
                rolled = rolled[:-1] * BASE + mixed[n - 1:]
                if n in GRAMS:
                    at = np.flatnonzero((left[:len(rolled)] >= n) & (lengths[word[:len(rolled)]] > n))
                    of.append(word[at])
                    made.append(self.bucket(rolled[at] + np.uint64(n)))
        return hashes, np.concatenate(of), np.concatenate(made)

    def learn(self, texts: list[list[str]]) -> None:
        """Know the words of these texts from now on."""
        if len(self.words) > CACHE_ENTRIES:
            self.reset()
        unseen: set[str] = set()
        for words in texts:
            unseen.update(set(words).difference(self.words))
        new = list(unseen)
        while new:
            some, size = [], 0
            while new and size < 1 << 19:
                some.append(new.pop())
                size += len(some[-1]) + 2
            hashes, of, made = self._make(some)
            self.words.update(zip(some, range(len(self.words), len(self.words) + len(some))))
            self.hashes = np.append(self.hashes, hashes)
            self.add(of, made, len(some))

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))

    def context(self, ids: np.ndarray) -> np.ndarray:
        """Buckets of the word pairs and of each word's recency."""
        hashes = self.hashes[ids]
        with np.errstate(over="ignore"):
            pairs = self.bucket(hashes[:-1] * PAIR + hashes[1:])
        order = np.argsort(ids, kind="stable")
        back = np.full(len(ids), 1 << 30)
        same = ids[order[1:]] == ids[order[:-1]]
        back[order[1:][same]] = (order[1:] - order[:-1])[same]
        steps = np.searchsorted(RECENCY, back, side="left").astype(np.uint64)
        return np.concatenate([pairs, self.bucket(steps + BASE)])


class Counter(Features):
    """Keeps each word's buckets, to train on, in one flat array."""

    def reset(self) -> None:
        super().reset()
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, of: np.ndarray, made: np.ndarray, n: int) -> None:
        sizes = np.bincount(of, minlength=n)
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.flat = np.append(self.flat, made[np.argsort(of, kind="stable")].astype(np.int32))

    def counted(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct buckets of each text and how often each occurs."""
        cut = [words_of(t or "") for t in texts]
        self.learn(cut)
        return [self._count(self.ids(words)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for words in cut]

    def _count(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return np.unique(np.concatenate([self.flat[at], self.context(ids)]), return_counts=True)


def train_on(features: list[tuple[np.ndarray, np.ndarray]], labels: list, buckets: int = BUCKETS, dims: int = DIMENSIONS,
             epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Gradient descent on one document after another, the rate falling to zero. Same input, same model."""
    classes = sorted(set(labels))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (buckets, dims)).astype(np.float32)
    output, bias = np.zeros((len(classes), dims), np.float32), np.zeros(len(classes), np.float32)
    target = {c: i for i, c in enumerate(classes)}
    usable = [i for i, (b, _) in enumerate(features) if len(b)]
    done, total = 0, max(1, epochs * len(usable))
    for _ in range(epochs):
        for i in rng.permutation(usable).tolist() if usable else []:
            step = rate * (1 - done / total)
            done += 1
            buckets_of, counts = features[i]
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ vectors[buckets_of]
            logits = output @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[target[labels[i]]] -= 1
            back = p @ output
            output -= step * np.outer(p, hidden)
            bias -= step * 0.1 * p
            # Each feature moves by its share times the document's length in features, at most one full step.
            vectors[buckets_of] -= np.outer(np.minimum(1, share * 50), step * back)
    return Model(vectors, output, bias, classes)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Train on at most ``sample_rows`` labelled rows, those with the lowest hash of their id; null when none has a label.

    The sample is drawn from the labels, so its ids are a bounded broadcast and no text is
    shuffled for it; it is cut again after the join, as ids may repeat. One task trains on
    it and sends the model, whose size does not depend on the data.
    """
    drawn = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(id_col), F.lit(SEED)).alias("h"))
    drawn = drawn.orderBy("h", "__id", "label").limit(sample_rows)
    sample = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), F.expr("id = __id"))
              .orderBy("h", "id", "label", F.xxhash64("text")).limit(sample_rows).select("label", "text").coalesce(1))

    def train(batches):
        counter, made, wanted = Counter(), [], []
        for batch in slices(batches):
            made += [(buckets.astype(np.uint32), counts.astype(np.float32)) for buckets, counts in counter.counted(batch.column(1).to_pylist())]
            wanted += batch.column(0).to_pylist()
        if wanted:
            model = train_on(made, wanted)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.vectors, model.output, model.bias)]
                                             + [pa.array([model.classes], pa.list_(pa.int32()))], names=["vectors", "output", "bias", "classes"])

    rows = sample.mapInArrow(train, "vectors binary, output binary, bias binary, classes array<int>").collect()
    if not rows:
        return None
    vectors, output, bias = (np.frombuffer(x, np.float32) for x in rows[0][:3])
    return Model(vectors.reshape(-1, DIMENSIONS), output.reshape(-1, DIMENSIONS), bias, list(rows[0].classes))


class Scorer(Features):
    """Scores texts: a word's entry is the sum of its features' weights and their number."""

    def __init__(self, model: Model, positive):
        self.weights, self.bias = model.weights(), model.bias.astype(np.float64)
        self.column = model.classes.index(positive) if positive in model.classes else None
        super().__init__(len(model.vectors))

    def reset(self) -> None:
        super().reset()
        self.sums = np.zeros((0, self.weights.shape[1] + 1))

    def add(self, of: np.ndarray, made: np.ndarray, n: int) -> None:
        columns = [np.bincount(of, self.weights[made, c], n) for c in range(self.weights.shape[1])]
        self.sums = np.concatenate([self.sums, np.stack([*columns, np.bincount(of, minlength=n)], axis=1)])

    def scores(self, texts: list[str | None]) -> list[float]:
        out = []
        for start in range(0, len(texts), 256):
            cut = [words_of(t or "") for t in texts[start:start + 256]]
            self.learn(cut)
            out += [self._score(words) for words in cut]
        return out

    def _score(self, words: list[str]) -> float:
        if self.column is None:
            return 0.0
        logits = self.bias
        if words:
            ids = self.ids(words)
            sums, context = self.sums[ids].sum(axis=0), self.context(ids)
            logits = (sums[:-1] + self.weights[context].sum(axis=0)) / (sums[-1] + len(context)) + self.bias
        p = np.exp(logits - logits.max())
        return float(p[self.column] / p.sum())


def _scorer(model: Model | None, positive):
    shipped = None if model is None else (model.vectors, model.output, model.bias, model.classes)

    def start():
        if shipped is None:
            return lambda texts: [0.5] * len(texts)
        return Scorer(Model(*shipped), positive).scores

    return start


def classify(docs: DataFrame, model: Model | None, text_col: str = "text", kept: list[str] | None = None, positive=1) -> DataFrame:
    """The columns ``kept`` of ``docs`` (default: its first), ``score`` (0 to 1: how likely label ``positive`` is) and ``predicted``.

    Per row, without a shuffle. A null or empty text gets the score of the bias alone;
    without a model (no labelled text) every score is 0.5. Repeated rows score alike.
    """
    make = _scorer(model, positive)

    def start():
        score = make()

        def work(texts):
            for s in score(texts):
                yield s, int(s >= 0.5)

        return work

    return map_texts(docs, [text_col], kept or [docs.columns[0]], {"score": "double", "predicted": "int"}, start)


def keep_positive(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.5, positive=1) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all columns as they were.

    A null text scores as an empty one. Without a model (no labelled row) every score is
    0.5, so all rows stay at the usual threshold. Empty input gives no rows.
    """
    make = _scorer(model, positive)

    def run(batches):
        score = make()
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([s >= threshold for s in score(texts)], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
