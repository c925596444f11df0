"""Toxicity scores from subword-bag embeddings under a linear softmax.

A word is the mean of the vectors of its character n-grams, a document the mean
of its words, and a two-class linear softmax reads the document; vectors and
softmax are trained jointly in numpy. N-grams are hashed, so a misspelling that
was never seen shares most of its vectors with the word it was made from.

The model is fitted on a bounded sample of labelled documents and then scores
every whole text. As the classifier is linear, a word adds a fixed amount to its
document's margin; scoring needs that number for each distinct word only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents without and with toxicity that the model is fitted on, at most.
SAMPLE = (3000, 2000)
BUCKETS = 1 << 18
DIMENSIONS = 4
NGRAMS = (3, 4, 5)
EPOCHS = 60
#: Factor on the mean of a document's words before the softmax: a few words among hundreds decide.
SHARPNESS = 32.0
#: N-grams in fewer words-in-documents of the sample are left out.
MIN_COUNT = 8
#: Words without weight that every document's mean includes: few words alone decide nothing.
PADDING = 100
#: Score from which a document is predicted toxic.
THRESHOLD = 0.7
#: Words whose amounts a scoring task remembers.
WORD_CACHE = 400_000
#: Step size of the optimizer, and what it adds to a gradient's size, in typical gradients.
RATE = 1.0
FLOOR = 0.3
SLOW_RATE = 0.05
MOMENTUM = 0.5
SEED = 41

_EDGES = ".,;:!?\"'()[]{}<>«»“”‘’…-–—*_`~"
_WORD = re.compile(r"\S+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of non-space without outer punctuation."""
    return [w for w in (x.strip(_EDGES) for x in text.lower().split()) if w]


def _subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words' n-grams and the place where each word's begin.

    Words stand between marks; a word as a whole is a subword too.
    """
    joined = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    ends = np.repeat(starts + lengths, lengths)
    place, owner = np.arange(len(codes)), np.repeat(np.arange(len(words)), lengths)
    found, owners = [], []
    value = np.zeros(len(codes), np.uint64)
    mixer = np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, max(NGRAMS) + 1):
        reach = np.minimum(place + n - 1, len(codes) - 1)
        value = (value ^ codes[reach]) * mixer
        value ^= value >> np.uint64(29)
        if n in NGRAMS:
            inside = place + n <= ends
            found.append(value[inside] + np.uint64(n)), owners.append(owner[inside])
    whole = np.zeros(len(words), np.uint64)
    np.add.at(whole, owner, (codes + np.uint64(1)) * (mixer ** ((place - starts[owner]).astype(np.uint64) + np.uint64(1))))
    found.append(whole), owners.append(np.arange(len(words)))
    value, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    value = value[order]
    value ^= value >> np.uint64(32)
    value = (value * mixer) >> np.uint64(40)
    counts = np.bincount(owner, minlength=len(words))
    return (value % np.uint64(BUCKETS)).astype(np.int64), np.cumsum(counts) - counts


def _segments(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


class _Gather:
    """Weighted sums over a sparse matrix of rows by columns, either way round."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, weights: np.ndarray, n_rows: int, n_columns: int):
        self.columns, self.weights, self.shape = columns, weights[:, None], (n_rows, n_columns)
        self.filled, self.starts = np.unique(rows, return_index=True)
        order = np.argsort(columns, kind="stable")
        self.t_rows, self.t_weights = rows[order], weights[order][:, None]
        self.t_filled, self.t_starts = np.unique(columns[order], return_index=True)

    def times(self, dense: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], dense.shape[1]), dense.dtype)
        out[self.filled] = _segments(dense[self.columns] * self.weights, self.starts)
        return out

    def transposed_times(self, dense: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[1], dense.shape[1]), dense.dtype)
        out[self.t_filled] = _segments(dense[self.t_rows] * self.t_weights, self.t_starts)
        return out


@dataclass(frozen=True)
class ToxicityModel:
    """``amounts`` is each bucket's part in the margin between the two classes."""

    amounts: np.ndarray
    bias: float

    def word_amounts(self, words: list[str]) -> list[float]:
        if not words:
            return []
        buckets, starts = _subwords(words)
        sums = np.add.reduceat(self.amounts[buckets].astype(np.float64), starts)
        return (sums / np.diff(np.append(starts, len(buckets)))).tolist()

    def scorer(self):
        known: dict[str, float] = {}

        def score(texts: list[str]) -> list[float]:
            split = [words_of(t) for t in texts]
            if len(known) > WORD_CACHE:
                known.clear()
            new = list(set().union(*split).difference(known))
            known.update(zip(new, self.word_amounts(new)))
            margins = [sum(map(known.__getitem__, ws)) / (len(ws) + PADDING) for ws in split]
            return (1 / (1 + np.exp(-np.clip(np.array(margins) + self.bias, -60, 60)))).tolist()

        return score


def _bags(split: list[list[str]]) -> tuple[_Gather, _Gather, np.ndarray]:
    """Documents by words, words by n-grams, and the n-grams' buckets."""
    vocabulary = sorted(set().union(*split))
    number = {w: i for i, w in enumerate(vocabulary)}
    doc, word, weight = [], [], []
    for d, ws in enumerate(split):
        ids, counts = np.unique(np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)), return_counts=True)
        doc.append(np.full(len(ids), d, np.int32)), word.append(ids.astype(np.int32)), weight.append((counts / (len(ws) + PADDING)).astype(np.float32))
    doc, word, weight = np.concatenate(doc), np.concatenate(word), np.concatenate(weight)
    found, sizes = [], []
    for at in range(0, len(vocabulary), 20_000):
        buckets, starts = _subwords(vocabulary[at : at + 20_000])
        found.append(buckets.astype(np.int32)), sizes.append(np.diff(np.append(starts, len(buckets))).astype(np.int32))
    buckets, sizes = np.concatenate(found), np.concatenate(sizes)
    word_of = np.repeat(np.arange(len(vocabulary), dtype=np.int32), sizes)
    seen = np.bincount(word, minlength=len(vocabulary))
    kept = np.bincount(buckets, weights=seen[word_of], minlength=BUCKETS)[buckets] >= MIN_COUNT
    used, compact = np.unique(buckets[kept], return_inverse=True)
    word_bags = _Gather(word_of[kept], compact.astype(np.int32), (1 / sizes[word_of[kept]]).astype(np.float32), len(vocabulary), len(used))
    return _Gather(doc, word, weight, len(split), len(vocabulary)), word_bags, used


def fit(texts: list[str], labels: list[int], toxic_share: float | None = None, epochs: int = EPOCHS, seed: int = SEED) -> ToxicityModel:
    """Train on texts with labels 0 and 1; ``toxic_share`` is the share of label 1
    outside the sample, for which the classes are weighted."""
    y = np.asarray(labels, np.int64)
    split = [words_of(t) for t in texts]
    if not any(split) or y.min() == y.max():  # one class only: its share is all that can be learnt
        return ToxicityModel(np.zeros(BUCKETS, np.float32), -4.0 if not len(y) or y.mean() < 0.5 else 4.0)
    doc_bags, word_bags, used = _bags(split)
    vectors, softmax, bias = _descend(doc_bags, word_bags, y, float(y.mean()) if toxic_share is None else toxic_share, epochs, seed)
    amounts = np.zeros(BUCKETS, np.float32)
    amounts[used] = SHARPNESS * vectors @ (softmax[:, 1] - softmax[:, 0])
    return ToxicityModel(amounts, float(bias[1] - bias[0]))


def _descend(doc_bags: _Gather, word_bags: _Gather, y: np.ndarray, share: float, epochs: int, seed: int):
    """N-gram vectors, softmax weights and biases after ``epochs`` passes of Adam over the sample."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5 / DIMENSIONS, 0.5 / DIMENSIONS, (word_bags.shape[1], DIMENSIONS)).astype(np.float32)
    softmax = rng.uniform(-0.5, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    # Classes keep their true odds only in part, as the square root, so that the rarer one is learnt as well.
    odds = np.sqrt([1 - share, share])
    per_class = odds / odds.sum() / np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    importance = per_class[y].astype(np.float32)[:, None]
    target = np.eye(2, dtype=np.float32)[y]
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (vectors, softmax, bias)]
    for step in range(1, epochs + 1):
        doc_vectors = doc_bags.times(word_bags.times(vectors))
        logits = SHARPNESS * (doc_vectors @ softmax) + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        delta = (p - target) * importance
        grads = (
            word_bags.transposed_times(doc_bags.transposed_times(SHARPNESS * (delta @ softmax.T))),
            SHARPNESS * (doc_vectors.T @ delta),
            delta.sum(axis=0),
        )
        floor = FLOOR * float(np.sqrt(np.square(grads[0]).mean()))
        for k, (value, grad) in enumerate(zip((vectors, softmax, bias), grads)):
            mean, square = state[k]
            mean += (1 - MOMENTUM) * (grad - mean)
            square += 0.01 * (grad * grad - square)
            # The floor keeps rare n-grams, whose gradients are small, from moving as far as common ones.
            size = np.sqrt(square / (1 - 0.99**step)) + (floor if k == 0 else 1e-12)
            value -= ((RATE if k == 0 else SLOW_RATE) * (1 - (step - 1) / epochs) * mean / (1 - MOMENTUM**step) / size).astype(np.float32)
    return vectors, softmax, bias


def held_out(key: str):
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: tuple[int, int] = SAMPLE) -> ToxicityModel:
    """Fit on at most ``sample`` documents of either class, those with the
    smallest hashes, among labelled rows that are not held out. A document with
    labels of both classes counts as toxic; null labels and texts are left out, as are
    labels without a document; of several documents with one id one is learnt from.
    Without labels, or with one class only, the model is a constant.
    Training runs in one executor task, which the bound on the sample keeps small."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    known = known.where(~held_out("_key"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    total = sum(counts.values())
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(F.xxhash64("_key"), "_key").limit(sample[value])
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most sum(sample) rows of an id and a class are sent to the documents.
    rows = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text")).where(F.col("_text").isNotNull()).join(F.broadcast(chosen), F.col("_id") == F.col("_key"))
    share = counts.get(1, 0) / total if total else None

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        sample = pd.concat(parts).sort_values(["_key", "_text"]).drop_duplicates("_key") if parts else pd.DataFrame({"_text": [], "_label": []})
        model = fit(sample["_text"].tolist(), sample["_label"].tolist(), share)
        yield pd.DataFrame({"amounts": [model.amounts.tobytes()], "bias": [model.bias]})

    # One task of a bounded size; the driver receives the model alone.
    made = rows.select("_key", "_label", "_text").repartition(1).mapInPandas(learn, "amounts binary, bias double").first()
    return ToxicityModel(np.frombuffer(made["amounts"], np.float32), made["bias"]) if made else fit([], [])


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with ``toxicity`` (0 to 1, higher: likelier toxic) and
    ``is_toxic``, which replace columns of those names.

    Null and empty texts, and texts without words, score by the bias alone. Texts of
    any length are scored whole. Rows that repeat an id are scored each by its own
    text, so that rows alike tie. An empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("toxicity", "is_toxic")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            yield pd.Series([s for at in range(0, len(texts), 1000) for s in scorer(texts[at : at + 1000])], dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = docs.select(*own).withColumn("toxicity", F.pandas_udf(run, "double")(F.col(text).cast("string")))
    return scored.withColumn("is_toxic", F.col("toxicity") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents predicted toxic; the columns stay."""
    model = train(docs, labels, key, text)
    return score(docs, model, key, text, threshold).where("not is_toxic").select(*docs.columns)
