"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give a score per document.

Only documents are labelled, so words get training tags from them: in a toxic document a word is tagged toxic if
one of its features (the word, or its first four to six letters) occurs far more often in toxic documents than in
others; everything in a clean document is tagged clean. The field has those features, a bias and the transitions
between two tags, and is fitted by gradient ascent on the conditional likelihood. Forward-backward marginals of
a text's words are summed up, and a logistic function fitted to the labels turns the sum into a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, lean

#: Labelled documents of each class, at most, from which the model is fitted (chosen by a hash of their id).
MAX_DOCS = 2500
#: Words of whole documents, at most, on which the field's weights are fitted.
MAX_WORDS = 200_000
THRESHOLD = 0.3
#: A feature counts only if its documents would be toxic by chance less often than exp(-SURPRISE).
SURPRISE = 13.0
WORD = re.compile(r"[^\W\d_]+")
BLOCK = 64
#: Words whose scores a task remembers; beyond that it forgets all and starts anew.
REMEMBERED = 100_000


def word_features(word: str) -> list[str]:
    return ["=" + word, *[word[:n] for n in (4, 5, 6) if len(word) > n]]


class Chain:
    """Forward-backward over many sequences at once, in blocks of words whose transfer matrices are chained."""

    def __init__(self, transitions: np.ndarray) -> None:
        self.t = np.exp(transitions)

    def _layout(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blocks = np.maximum(1, -(-sizes // BLOCK))
        first = np.cumsum(blocks) - blocks
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first * BLOCK, sizes)
        return blocks, first, place

    def run(self, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Marginal of tag 1 per word, forward and backward messages (normalised), and the sum of log partition functions."""
        blocks, first, place = self._layout(sizes)
        n = int(blocks.sum())
        e = np.ones((n * BLOCK, 2))
        top = np.maximum(scores, 0)
        e[place, 0], e[place, 1] = np.exp(-top), np.exp(scores - top)
        live = np.zeros(n * BLOCK, bool)
        live[place] = True
        e, live = e.reshape(n, BLOCK, 2).transpose(1, 0, 2), live.reshape(n, BLOCK).T
        t = self.t
        heads = np.zeros(n, bool)
        heads[first] = True
        # how a block carries a message from its left to its right end, as a matrix scaled to keep its size
        carry = np.repeat(np.eye(2)[None], n, axis=0)
        for i in range(BLOCK):
            step = (carry @ t) * e[i][:, None, :]
            step /= step.sum(axis=(1, 2), keepdims=True)
            carry = np.where(live[i][:, None, None], step, carry)
        left, right = np.empty((n, 2)), np.ones((n, 2))
        left[first] = 0.5
        last = first + blocks - 1
        for k in range(1, int(blocks.max(initial=1))):
            at = first[blocks > k] + k
            message = np.einsum("ni,nij->nj", left[at - 1], carry[at - 1])
            left[at] = message / message.sum(axis=1, keepdims=True)
            at = last[blocks > k] - k
            message = np.einsum("nij,nj->ni", carry[at + 1], right[at + 1])
            right[at] = message / message.sum(axis=1, keepdims=True)
        alpha, beta = np.empty((BLOCK, n, 2)), np.empty((BLOCK, n, 2))
        scale = np.zeros((BLOCK, n))
        message = left
        for i in range(BLOCK):
            new = (message @ t) * e[i]
            total = new.sum(axis=1)
            scale[i] = np.where(live[i], np.log(total), 0)
            message = np.where(live[i][:, None], new / total[:, None], message)
            alpha[i] = message
        message = right
        for i in range(BLOCK - 1, -1, -1):
            beta[i] = message
            new = (message * e[i]) @ t.T
            message = np.where(live[i][:, None], new / new.sum(axis=1, keepdims=True), message)
        alpha, beta = (x.transpose(1, 0, 2).reshape(-1, 2)[place] for x in (alpha, beta))
        both = alpha * beta
        return both[:, 1] / both.sum(axis=1), alpha, beta, float(scale.sum() + top.sum())


class Model:
    def __init__(self, weights: dict[str, float], bias: float, transitions: np.ndarray, slope: float, shift: float) -> None:
        self.weights, self.bias, self.chain, self.slope, self.shift = weights, bias, Chain(transitions), slope, shift
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def _score(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in word_features(word))

    def marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the probability of the toxic tag of each of its words."""
        known = self.known
        words = [WORD.findall((t or "").lower()) for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        for w in {w for each in words for w in each if w not in known}:
            known[w] = self._score(w)
        sizes = np.array([len(w) for w in words], np.int64)
        if not sizes.sum():
            return [np.empty(0) for _ in words]
        scores = np.fromiter((s for each in words for s in map(known.__getitem__, each)), np.float64, sizes.sum())
        return np.split(self.chain.run(scores, sizes)[0], np.cumsum(sizes)[:-1])

    def document_scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        x = np.array([math.log(m.sum() + 1e-3) for m in marginals])
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -40, 40)))

    def offsets(self, text: str | None, marginals: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
        """Start and end (code points) of the spans of neighbouring words whose toxic tag is likelier than least."""
        out: list[tuple[int, int]] = []
        joined = False
        for found, p in zip(WORD.finditer(text or ""), marginals):
            if p >= least:
                out[-1:] = [(out[-1][0], found.end())] if joined else [*out[-1:], found.span()]
            joined = p >= least
        return out


def _without_copies(rows: list[tuple[str | None, int]]) -> list[tuple[str | None, int]]:
    """One text of each group of copies, also near ones, as copies would make chance words look telling.

    Texts of which one of four least hashes of three-word shingles is equal count as copies.
    """
    seen: set[tuple[int, int, int]] = set()
    out = []
    for text, y in rows:
        words = (text or "").lower().split()
        hashes = np.array([zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))], np.uint64)
        keys = {(y, k, int((hashes * np.uint64(m) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate((1, 2654435761, 2246822519, 3266489917))}
        if not keys & seen:
            out.append((text, y))
        seen |= keys
    return out


def _surprise(a: int, b: int, share: float) -> float:
    """Bound on -log of the chance that a of a + b documents are toxic if a share of all is; 0 if fewer than expected."""
    x = a / (a + b)
    if x <= share:
        return 0.0
    return (a + b) * (x * math.log(x / share) + (b and (1 - x) * math.log((1 - x) / (1 - share))))


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """Fit the field and the score to texts with labels 0 or 1; without any toxic text nothing is toxic."""
    rows = _without_copies(rows)
    texts = [WORD.findall((t or "").lower()) for t, _ in rows]
    labels = np.array([y for _, y in rows], np.int64)
    n1, n0 = int(labels.sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return Model({}, -12.0, np.zeros((2, 2)), 1.0, -6.0 if not n1 else 6.0)
    seen: dict[str, list[str]] = {}
    found = (Counter(), Counter())
    for words, y in zip(texts, labels):
        features: set[str] = set()
        for w in set(words):
            if w not in seen:
                seen[w] = word_features(w)
            features.update(seen[w])
        found[y].update(features)
    odds = {f: math.log((a + 0.1) / (n1 + 0.2)) - math.log((found[0][f] + 0.1) / (n0 + 0.2)) for f, a in found[1].items() if _surprise(a, found[0][f], n1 / (n1 + n0)) >= SURPRISE}
    strong = {f for f, x in odds.items() if x >= 3.0}
    vocabulary = {f: i for i, f in enumerate(sorted(f for f, x in odds.items() if x >= 1.5))}
    chosen, size = [], 0
    ranks = {0: 0, 1: 0}
    by_turn = []
    for i, y in enumerate(labels):  # both classes by turns, whole documents
        by_turn.append((ranks[int(y)], i))
        ranks[int(y)] += 1
    for _, i in sorted(by_turn):
        if size + len(texts[i]) <= MAX_WORDS and texts[i]:
            chosen.append(i)
            size += len(texts[i])
    sizes = np.array([len(texts[i]) for i in chosen], np.int64)
    tags = np.array([float(labels[i] and any(f in strong for f in seen[w])) for i in chosen for w in texts[i]])
    pairs = [(k, vocabulary[f]) for k, w in enumerate(w for i in chosen for w in texts[i]) for f in seen[w] if f in vocabulary]
    at, which = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ())))
    n = len(vocabulary)
    theta = np.zeros(n + 5)
    theta[:n] = [odds[f] for f in vocabulary]  # from the features' own odds, so that few steps are left to go
    theta[n] = -9.0
    inner = np.ones(len(tags), bool)
    inner[np.cumsum(sizes) - sizes] = False
    after = np.flatnonzero(inner)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (tags[after - 1].astype(int), tags[after].astype(int)), 1)
    observed = np.concatenate((np.bincount(which, tags[at], n) if n else [], [tags.sum()], seen_pairs.ravel()))
    moment, spread = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, 41):
        scores = np.bincount(at, theta[which], len(tags)) + theta[n]
        chain = Chain(theta[n + 1 :].reshape(2, 2))
        p, alpha, beta, _ = chain.run(scores, sizes)
        e = np.stack((np.ones(len(after)), np.exp(np.clip(scores[after], -30, 30))), axis=1)
        joint = alpha[after - 1][:, :, None] * chain.t[None] * (e * beta[after])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        expected = np.concatenate((np.bincount(which, p[at], n) if n else [], [p.sum()], joint.sum(axis=0).ravel()))
        slope = (observed - expected) - 0.05 * theta
        moment, spread = 0.9 * moment + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        theta += 0.4 * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8) / math.sqrt(1 + step / 15)
    weights = {f: float(theta[i]) for f, i in vocabulary.items() if abs(theta[i]) > 1e-3}
    model = Model(weights, float(theta[n]), theta[n + 1 :].reshape(2, 2), 1.0, 0.0)
    x = np.concatenate([[math.log(m.sum() + 1e-3) for m in model.marginals([t for t, _ in rows[i : i + 64]])] for i in range(0, len(rows), 64)])
    model.slope, model.shift = _logistic(x, labels)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic function by Newton's steps with a small ridge; a quarter of the weight goes to class 1."""
    weight = np.where(y == 1, 0.25 / y.sum(), 0.75 / (len(y) - y.sum()))
    theta, design = np.array([1.0, 2.0]), np.stack((x, np.ones(len(x))), axis=1)
    ridge = np.array([1e-3, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -40, 40)))
        slope = design.T @ (weight * (y - p)) - ridge * theta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        theta = theta + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return max(float(theta[0]), 0.1), float(theta[1])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[str | None, int]]:
    """At most MAX_DOCS labelled texts of each class that aren't held out: a bounded sample, chosen by a hash of the id."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    ids = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(MAX_DOCS).collect()]
    if not ids:
        return []
    picked = docs.sparkSession.createDataFrame(ids, "id long, y int")  # at most 2 * MAX_DOCS rows, so it may be broadcast
    mine = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")
    rows = mine.groupBy("id", "y").agg(F.min("text").alias("text")).toPandas().sort_values("id")
    return list(zip(rows["text"].tolist(), rows["y"].tolist()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1), n_toxic_words, spans (starts and ends in code points).

    Null and empty texts have no words and the score of none. Repeated rows and rows with a null id are scored like any
    other; a very long text is scored whole, in blocks of words that are chained; other columns are ignored, so their
    names may be any. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = part.column(1).to_pylist()
                found = model.marginals(texts)
                flagged = [int((m >= 0.5).sum()) for m in found]
                spans = [[{"start": a, "end": b} for a, b in model.offsets(t, m)] if k else [] for t, m, k in zip(texts, found, flagged)]
                arrays = [part.column(0), pa.array(model.document_scores(found), pa.float64()), pa.array(flagged, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "n_toxic_words", "spans"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(lean(run), "doc_id long, score double, n_toxic_words long, spans array<struct<start:int,end:int>>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows with a score below the threshold, all columns as they were; cases as in score()."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield part.filter(pa.array(model.document_scores(model.marginals(part.column(at).to_pylist())) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_toxic_words")
