"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Word and word-prefix counts by label, over a bounded sample of labelled rows, give the lexicons
   (words) and the patterns (word beginnings) that speak for toxicity. Each voter owns one share of
   them: it votes toxic where its share occurs; one voter votes clean where nothing occurs, and the
   annotators' label is a voter like the others.
2. The label model estimates by expectation maximisation how often each voter speaks in toxic and in
   clean texts. Voters that agree more than their accuracies explain are correlated; each voter's
   evidence is divided by one plus its correlations with the others.
3. A logistic regression over the words and beginnings (by the logarithm of how many distinct words
   have them) learns the posterior labels. Its
   scores are calibrated on the sample, and every whole text is scored by it.

Defined cases: null and empty texts have no words and get the score of the bias alone. A training set
without both labels gives every text the training rate of toxic labels (0 without any label).
Repeated rows are scored each by itself; of several labels of one id the highest counts.
Columns other than doc_id and text are never read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import emit, fold, sample_ids, texts, tidy
from twinsieve.session import ship_package, written

WORDS = re.compile(r"[^\W_]+")
PREFIXES = range(3, 11)
CACHE = 400_000  # words whose features a worker remembers
HELD = 200_000  # terms that a task counts before it sends them on


@dataclass
class Settings:
    """``rows`` bounds the labelled rows that are fitted; ``terms`` the words and beginnings that count."""

    rows: int = 20_000
    terms: int = 6_000
    least_docs: int = 3
    voter_terms: int = 160
    voters: int = 10
    rounds: int = 40
    epochs: int = 60
    l2: float = 2e-4
    threshold: float = 0.7


@dataclass
class Model:
    """Weights by term: a word ends in ``$``, a beginning does not."""

    weights: dict[str, float]
    bias: float
    scale: float = 1.0
    shift: float = 0.0


def terms_of(word: str) -> Iterator[str]:
    yield word + "$"
    for k in PREFIXES:
        if len(word) >= k:
            yield word[:k]


def _terms(text: str) -> Counter[str]:
    """The terms of a text, with the number of distinct words that have each."""
    return Counter(t for w in set(WORDS.findall(text.lower())) for t in terms_of(w))


TERMS = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
HITS = pa.schema([("toxic", pa.int32()), ("ids", pa.binary())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by term and label, added up until ``HELD`` terms are held."""
    found: dict[str, list[int]] = {}

    def pack() -> pa.RecordBatch:
        return emit(TERMS, [list(found), [n[1] for n in found.values()], [n[0] for n in found.values()]])

    for batch in batches:
        for text, label in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            for term in _terms(text):
                found.setdefault(term, [0, 0])[label] += 1
        if len(found) >= HELD:
            yield pack()
            found.clear()
    yield pack()


def labelled_sample(documents: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """text and toxic of at most ``rows`` labelled ids."""
    own = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    chosen = sample_ids(own, "doc_id", settings.rows)
    own = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("_sampled")).select("_sampled", "toxic")
    return (documents.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("_sampled"))
            .select("text", "toxic"))


def posteriors(votes: np.ndarray, prior: float, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of toxic for each row of ``votes`` (1 speaks, 0 silent), by the label model.

    Returns also the two rates of speaking per voter (clean, toxic) and the correlations of the voters.
    """
    p = np.clip(votes.mean(axis=1) * 2, 0.02, 0.98)
    weight = np.ones(votes.shape[1])
    for _ in range(rounds):
        rates = np.array([((1 - p) @ votes + 0.05) / ((1 - p).sum() + 0.1), (p @ votes + 0.05) / (p.sum() + 0.1)])
        share = np.clip(p.mean(), 1e-3, 1 - 1e-3) * 0.5 + prior * 0.5
        expected = np.outer(1 - p, rates[0]) + np.outer(p, rates[1])
        rest = votes - expected
        spread = np.sqrt((rest ** 2).mean(axis=0)) + 1e-6
        correlation = (rest.T @ rest) / len(votes) / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        weight = 1 / (1 + np.clip(correlation, 0, None).sum(axis=1))
        log = np.log(rates[1] / rates[0]) * votes + np.log((1 - rates[1]) / (1 - rates[0])) * (1 - votes)
        z = log @ weight + np.log(share / (1 - share))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p, rates, correlation


def _regress(rows: list[np.ndarray], amounts: list[np.ndarray], y: np.ndarray, width: int,
             settings: Settings) -> tuple[np.ndarray, float]:
    """Logistic regression by adaptive gradient descent over rows of active terms and their amounts."""
    flat, amount = np.concatenate(rows), np.concatenate(amounts)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, bias = np.zeros(width), float(np.log(y.mean() / (1 - y.mean())))
    square, square_b = np.full(width, 1e-6), 1e-6
    for _ in range(settings.epochs):
        z = np.bincount(owner, w[flat] * amount, minlength=len(rows)) + bias
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        step = np.bincount(flat, gap[owner] * amount, minlength=width) / len(rows) + settings.l2 * w
        square += step ** 2
        square_b += gap.mean() ** 2
        w -= 0.5 * step / np.sqrt(square)
        bias -= 0.5 * gap.mean() / np.sqrt(square_b)
    return w, bias


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logits by Newton's method on the labels."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        s = p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1e-2, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-2]])
        move = np.linalg.solve(h, g)
        size = np.abs(move).max()
        a, b = a - move[0] / max(1, size), b - move[1] / max(1, size)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(documents: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Learn a model from ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    ship_package(documents.sparkSession)
    settings = settings or Settings()
    sample = written(labelled_sample(documents, labels, settings), "toxicity")
    sizes = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model({}, 30.0 if toxic else -30.0)
    counts = (sample.mapInArrow(tidy(_count), "term string, toxic long, clean long").groupBy("term")
              .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
              .where(F.col("toxic") + F.col("clean") >= settings.least_docs))
    # How far the toxic share of a term's documents stands from the sample's, in deviations.
    seen, rate = F.col("toxic") + F.col("clean"), toxic / (toxic + clean)
    z = (F.col("toxic") - seen * rate) / F.sqrt(seen * (rate * (1 - rate)))
    top = counts.withColumn("z", z).orderBy(F.desc(F.abs("z")), "term").limit(settings.terms).collect()
    names = [r["term"] for r in top]
    position = {t: i for i, t in enumerate(names)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [np.array(sorted((position[t], n) for t, n in _terms(x).items() if t in position), np.int32).tobytes()
                    for x in texts(batch.column(0))]
            yield emit(HITS, [batch.column(1), hits])

    got = sample.mapInArrow(tidy(find), "toxic int, ids binary").limit(settings.rows * 2).collect()
    got = sorted((r[0], bytes(r[1])) for r in got)
    pairs = [np.frombuffer(b, np.int32).reshape(-1, 2) for _, b in got]
    rows, amounts = [x[:, 0] for x in pairs], [np.log2(1.0 + x[:, 1]) for x in pairs]
    y = np.array([t for t, _ in got], float)

    # Voters: words and beginnings whose documents are nearly all toxic, dealt out in turn.
    sure = [i for i, r in enumerate(top) if r["z"] > 3 and (r["toxic"] + 0.5) / (r["toxic"] + r["clean"] + 1) > 0.6]
    voter = np.full(len(names), -1)
    for offset, kind in ((0, [i for i in sure if names[i].endswith("$")]), (settings.voters, [i for i in sure if not names[i].endswith("$")])):
        for turn, i in enumerate(kind[:settings.voter_terms]):
            voter[i] = offset + turn % settings.voters
    votes = np.zeros((len(rows), 2 * settings.voters + 2))
    for i, r in enumerate(rows):
        speaking = voter[r]
        votes[i, speaking[speaking >= 0]] = 1
    votes[:, -2] = votes[:, :-2].sum(axis=1) == 0
    votes[:, -1] = y
    votes = votes[:, (votes.sum(axis=0) > 0)]
    p, _, _ = posteriors(votes, float(y.mean()), settings.rounds)
    w, bias = _regress(rows, amounts, np.clip(p, 1e-4, 1 - 1e-4), len(names), settings)
    scale, shift = _calibrate(np.array([w[r] @ a for r, a in zip(rows, amounts, strict=True)]) + bias, y)
    return Model({t: float(x) for t, x in zip(names, w, strict=True) if x}, bias, scale, shift)


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_texts(batch: list[str], model: Model) -> np.ndarray:
    """The calibrated score of each text. A term counts by the logarithm of its distinct words."""
    weights, cache, out = model.weights, {}, np.empty(len(batch))
    for n, text in enumerate(batch):
        found: dict[str, int] = {}
        for word in set(WORDS.findall(text.lower())):
            own = cache.get(word)
            if own is None:
                if len(cache) >= CACHE:
                    cache.clear()
                own = cache[word] = tuple(t for t in terms_of(word) if t in weights)
            for term in own:
                found[term] = found.get(term, 0) + 1
        out[n] = sum(weights[t] * log2(1 + found[t]) for t in sorted(found)) + model.bias
    return 1 / (1 + np.exp(-np.clip(model.scale * out + model.shift, -500, 500)))


def score(documents: DataFrame, model: Model, threshold: float = 0.7, parts: int = 3, held: int = 1) -> DataFrame:
    """A row per row of ``documents``: doc_id, held_out, score, predicted."""
    ship_package(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("long"), fold("doc_id", parts, held).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score_texts(texts(batch.column(2)), shared.value)
            yield emit(SCORED, [batch.column(0), batch.column(1), s, (s >= threshold).astype(np.int32)])

    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def fit_on_fold(documents: DataFrame, labels: DataFrame, settings: Settings | None = None,
                parts: int = 3, held: int = 1) -> Model:
    """Learn only from rows outside the held fold."""
    return fit(documents, labels.where(~fold("doc_id", parts, held)), settings)


def rejected(documents: DataFrame, model: Model, threshold: float = 0.7) -> F.Column:
    """Whether a row's text scores ``threshold`` or more, as a column expression."""
    ship_package(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(score_texts(texts(column), shared.value) >= threshold)

    return F.arrow_udf(tidy(judge), "boolean")(F.col("text"))
