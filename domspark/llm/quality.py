"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line has features of its own and of the lines beside it, and is good or bad. The labels are the documents', those of the lines are hidden: training
finds them together with the field (posterior regularization, Ganchev et al. 2010). In turns, the lines' posteriors under the present field are moved
as little as it takes for each document to have at least MOST of its text on the side of its label, and the field is fitted to these posteriors. A good
document may so have bad lines and a bad one good lines, and the transitions learn how one follows the other.

A document's share of good text is the mean of its lines' forward-backward marginals, weighted by the lines' lengths; its score is a logistic function
of that share, fitted to the labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 1000  # labelled documents of each label that the field is fitted on at most
SEGMENT = 48  # lines of a training chain; a long document gives PER_DOC chains, spread over its whole length
PER_DOC = 4
ROUNDS = 180
WARM = 80  # rounds in which each line still has its document's label, and lines are independent
REFRESH = 20  # rounds between two looks at the hidden labels
MOST = 0.6  # of a document's text that is on the side of its label at least
SHARPER = 3.0  # how much surer hidden labels are than the field that they come from
OWN = 13
FEATURES = 3 * OWN + 1
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_STOP = b".,;:?'\"()-"
_MARK = b"!"
_ODD = b"#$%&*@^~=+_{}[]<>|\\/`"
_BEYOND = bytes(range(128, 256))


def own_features(line: bytes, before: set[bytes]) -> list[float]:
    """What a line says by itself; `before` are the lines seen so far in the document."""
    n = len(line)
    words = line.split()
    k = len(words)
    if not n:
        return [0.0] * (OWN - 1) + [1.0]
    count = lambda chars: n - len(line.translate(None, chars))
    upper, lower, odd = count(_UPPER), count(_LOWER), count(_ODD)
    distinct = len(set(words))
    return [
        np.log1p(n) / 5,
        upper / (upper + lower + 1),
        10 * count(_DIGIT) / n,
        5 * count(_STOP) / n,
        10 * count(_MARK) / n,
        10 * odd / n,
        count(_BEYOND) / n,
        n / (k + 1) / 10,
        distinct / k if k else 0.0,
        (k - distinct) / np.sqrt(k + 1) / 5,
        float(line in before),
        float(line.rstrip()[-1:] in (b".", b"?")),
        0.0,
    ]


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines, OWN) features and the lines' weights."""
    before: set[bytes] = set()
    rows, weights = [], []
    for line in text.encode().split(b"\n"):
        rows.append(own_features(line, before))
        weights.append(max(1, len(line)))
        before.add(line)
    return np.array(rows), np.array(weights, dtype=float)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """The features of each line, those of the lines before and after it (zeros beyond the ends) and a constant."""
    none = np.zeros((1, own.shape[1]))
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), np.ones((len(own), 1))])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class LineField:
    """Two states, 0 bad and 1 good: emission weights for the good state, transition weights, and the logistic function from the share of good
    text to the score."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, mean: np.ndarray, scale: np.ndarray, slope: float = 1.0, middle: float = 0.5):
        self.weights, self.transitions, self.mean, self.scale, self.slope, self.middle = weights, transitions, mean, scale, slope, middle

    @classmethod
    def fit(cls, chains: list[tuple[np.ndarray, int]], lengths: list[np.ndarray] | None = None, rounds: int = ROUNDS, ridge: float = 0.02) -> LineField:
        """Gradient ascent (Adam) on all chains (features of their lines, document's label) at once; each chain counts as one, and the labels weigh the same."""
        every = np.vstack([x for x, _ in chains]) if chains else np.zeros((1, OWN))
        mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        field = cls(np.zeros(FEATURES), np.zeros((2, 2)), mean, scale)
        labels = {y for _, y in chains}
        if len(labels) < 2:
            field.weights[-1] = 0.0 if not labels else (4.0 if 1 in labels else -4.0)
            field.slope = 4.0
            return field
        longest = max(len(x) for x, _ in chains)
        inputs = np.zeros((len(chains), longest, FEATURES))
        part = np.zeros((len(chains), longest))  # of its chain's text that a line is
        gold = np.array([y for _, y in chains])
        for i, (x, _) in enumerate(chains):
            inputs[i, : len(x)] = with_neighbours((x - mean) / scale)
            own = np.ones(len(x)) if lengths is None else lengths[i]
            part[i, : len(x)] = own / own.sum()
        there = part > 0
        share = np.where(gold == 1, 0.5 / max(1, (gold == 1).sum()), 0.5 / max(1, (gold == 0).sum()))
        share = (share / there.sum(axis=1))[:, None]
        both = there[:, 1:] & there[:, :-1]
        hard = np.zeros((len(chains), longest - 1, 2, 2))
        hard[np.arange(len(chains)), :, gold, gold] = 1.0
        good_then, pairs_then = gold[:, None] * np.ones((1, longest)), hard
        theta, m, v = np.zeros(FEATURES + 4), 0.0, 0.0
        held_back = np.full(FEATURES + 4, ridge / 10)
        held_back[OWN : 3 * OWN] = ridge  # what a line says itself comes before what its neighbours say
        for step in range(1, rounds + 1):
            w, t = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
            emit = inputs @ w
            if step > WARM and (step - WARM) % REFRESH == 1:
                good_then, pairs_then = hidden_labels(emit, t, there, part, gold)
            good, pairs = batch_marginals(emit, t, there)
            slope_w = np.einsum("bt,btf->f", (good_then - good) * there * share, inputs)
            slope_t = (((pairs_then - pairs) * both[:, :, None, None]) * share[:, :, None, None]).sum(axis=(0, 1))
            if step <= WARM:  # with one label for all lines, transitions would learn to explain everything
                slope_t = np.zeros(4)
            slope = np.concatenate([slope_w, slope_t.ravel()]) - held_back * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta = theta + 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        field.weights, field.transitions = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        good, _ = batch_marginals(inputs @ field.weights, field.transitions, there)
        field.slope, field.middle = fitted_logistic((good * part).sum(axis=1), gold)
        return field

    def marginals(self, own: np.ndarray) -> np.ndarray:
        """P(good) of each line of a document."""
        emit = np.clip(with_neighbours((own - self.mean) / self.scale) @ self.weights, -60, 60)
        return chain_marginals(emit.tolist(), self.transitions)

    def score(self, text: str) -> float:
        own, weight = line_features(text)
        share = (self.marginals(own) * weight).sum() / weight.sum()
        return float(_sigmoid(self.slope * (share - self.middle)))


def hidden_labels(emit: np.ndarray, t: np.ndarray, there: np.ndarray, part: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marginals closest to the field's own, sharpened, under which at least MOST of each chain's text is on the side of its label.

    They are the field's with one number added to the emissions of a chain, in proportion to its lines' lengths: the least that does it, by bisection.
    """
    emit = SHARPER * emit  # else a field that is unsure of its lines stays so
    side = np.where(gold == 1, 1.0, -1.0)[:, None]
    pull = part / np.maximum(part.max(axis=1, keepdims=True), 1e-9)
    low, high = np.zeros((len(gold), 1)), np.full((len(gold), 1), 60.0)
    for k in range(8):
        middle = (low + high) / 2 if k else low
        good, pairs = batch_marginals(emit + side * middle * pull, t, there)
        held = (np.where(gold[:, None] == 1, good, 1 - good) * part).sum(axis=1, keepdims=True) >= MOST
        if k:
            low, high = np.where(held, low, middle), np.where(held, middle, high)
        else:
            high = np.where(held, 0.0, high)
    return batch_marginals(emit + side * high * pull, t, there)


def fitted_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the logistic function that fits labels y best, the two labels weighing the same; a small penalty keeps the slope finite."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    a, b = 4.0, -2.0  # a * x + b
    for _ in range(50):  # Newton
        p = _sigmoid(a * x + b)
        g, h = weight * (y - p), weight * p * (1 - p)
        slope = np.array([(g * x).sum() - 1e-3 * a, g.sum() - 1e-3 * (b + a / 2)])
        curve = np.array([[(h * x * x).sum() + 1e-3 + 2.5e-4, (h * x).sum() + 5e-4], [(h * x).sum() + 5e-4, h.sum() + 1e-3]])
        step = np.linalg.solve(curve, slope)
        a, b = a + np.clip(step[0], -4, 4), b + np.clip(step[1], -4, 4)
    a = max(a, 0.1)
    return float(a), float(-b / a)


def chain_marginals(emit: list[float], transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over two states, kept as probabilities that are normalized at each line."""
    (t00, t01), (t10, t11) = np.exp(transitions - transitions.max()).tolist()
    good = [1 / (1 + np.exp(-e)) for e in emit]
    n = len(emit)
    ahead, p = [0.0] * n, 0.5
    for i, g in enumerate(good):
        if i:
            one, zero = (1 - p) * t01 + p * t11, (1 - p) * t00 + p * t10
        else:
            one = zero = 0.5
        one, zero = one * g, zero * (1 - g)
        p = ahead[i] = one / (one + zero)
    out, b1, b0 = np.empty(n), 0.5, 0.5
    for i in range(n - 1, -1, -1):
        one, zero = ahead[i] * b1, (1 - ahead[i]) * b0
        out[i] = one / (one + zero)
        x1, x0 = good[i] * b1, (1 - good[i]) * b0
        b1, b0 = t10 * x0 + t11 * x1, t00 * x0 + t01 * x1
        b1, b0 = b1 / (b1 + b0), b0 / (b1 + b0)
    return out


def batch_marginals(emit: np.ndarray, t: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of being good (chains, lines) and of neighbouring states (chains, lines - 1, 2, 2) for padded chains."""
    n, longest = emit.shape
    e = np.stack([np.zeros_like(emit), np.clip(emit, -60, 60)], axis=2)
    e = np.exp(e - e.max(axis=2, keepdims=True))
    trans = np.exp(t - t.max())
    ahead, back = np.zeros((n, longest, 2)), np.full((n, longest, 2), 0.5)
    p = e[:, 0]
    ahead[:, 0] = p / p.sum(axis=1, keepdims=True)
    for i in range(1, longest):
        p = (ahead[:, i - 1] @ trans) * e[:, i]
        ahead[:, i] = p / p.sum(axis=1, keepdims=True)
    for i in range(longest - 2, -1, -1):
        b = (back[:, i + 1] * e[:, i + 1]) @ trans.T
        b = b / b.sum(axis=1, keepdims=True)
        back[:, i] = np.where(there[:, i + 1, None], b, 0.5)
    both = ahead * back
    good = both[:, :, 1] / both.sum(axis=2)
    pairs = ahead[:, :-1, :, None] * trans[None, None] * (e * back)[:, 1:, None, :]
    return good, pairs / pairs.sum(axis=(2, 3), keepdims=True)


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = ([], [], [])
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own, weight = line_features(text.as_py())
            starts = list(range(0, len(own), SEGMENT))
            for k in sorted({round(i * (len(starts) - 1) / max(1, PER_DOC - 1)) for i in range(PER_DOC)}):
                out[0].append(label)
                out[1].append(own[starts[k] : starts[k] + SEGMENT].astype("<f4").tobytes())
                out[2].append(weight[starts[k] : starts[k] + SEGMENT].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["label", "own", "weight"])


def _score_rows(field: LineField):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [field.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineField:
    """The field, fitted on at most `sample` documents of each label: those with the smallest hashes of their doc_ids among the rows that aren't held out.

    Of each of these documents PER_DOC chains of SEGMENT lines are taken, spread over its whole length; a document of fewer lines is taken whole. labels: doc_id, quality (1 good, 0 bad). Null labels and ids are ignored; of contradicting labels of a document the lower one counts.
    Without labels every score is a half; with one label only, all scores are near it.
    """
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    rows = rows.where(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    # Twice the rows that are asked for are drawn by hash, so that no partition sends many more than its share.
    small = lambda y: F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1 << 30, (2 * sample << 30) // max(1, counts.get(y, 0)))
    picked = [rows.where((F.col("label") == y) & small(y)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    ids = [(r.doc_id, r.label) for p in picked for r in p.collect()]  # 2 * sample rows at most
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = texts.select("label", "text").mapInArrow(_train_rows, "label int, own binary, weight binary").orderBy(F.xxhash64("own", "label"), "own", "label").limit(2 * sample * PER_DOC).collect()
    chains = [(np.frombuffer(r.own, dtype="<f4").reshape(-1, OWN).astype(float), r.label) for r in found]
    return LineField.fit(chains, [np.frombuffer(r.weight, dtype="<f4").astype(float) for r in found])


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    The score is between 0 and 1, higher where label 1 is likelier; predicted is 1 from 0.5 on. A null or empty text is one empty
    line and is scored as such. A row with a null doc_id is never held out. Repeated rows score alike. An empty table gives an empty
    result; other columns are ignored, and no column but the text goes into a score.
    """
    field = fit_quality(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(_score_rows(field), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def _keep(field: LineField, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([field.score(t.as_py() or "") >= 0.5 for t in batch.column(text)], pa.bool_()))

    return run


def quality_filter(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier predicts to be good, with all their columns.

    Each row is judged by its own text, a null text as an empty one, so null and repeated doc_ids and repeated rows need no care. An empty table gives an
    empty result; columns of any other names pass through.
    """
    field = fit_quality(docs, labels, sample)
    return docs.mapInArrow(_keep(field, docs.columns.index("text")), docs.schema)
