"""Language identification: averaged hashed subword embeddings and a linear softmax.

Texts are lower-cased, runs of non-letters become one boundary, and every n-gram of one to
three characters (boundaries included) is hashed to a bucket. A text is the mean of its
buckets' embeddings; a linear softmax over it gives the languages. Both layers are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled rows.
As both layers are linear, prediction sums one small logit vector per n-gram.

The softmax is calibrated on a part of the sample that is not trained on: by a temperature,
and by the lowest score at which accepted predictions reach the wanted accuracy. Predictions
under that score keep their language and are marked ``rejected``.

Defined cases: null texts and texts without a letter get ``und`` and score 0; equal scores go to
the language that sorts first; without any labelled row all get ``und``. Repeated rows are
predicted each by itself. Extra columns, whatever their names, are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import emit, fold, sample_ids, texts, tidy
from twinsieve.session import ship_package

UNKNOWN = "und"
ORDERS = (1, 2, 3)
SPACE = 32
#: Fixed odd multipliers of the n-gram hash.
MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
CELLS = 8_000_000  # floats of n-gram logits that a worker holds at once


@dataclass
class Settings:
    """``rows`` bounds the labelled rows that are fitted; ``accuracy`` sets the rejection."""

    rows: int = 4000
    bucket_bits: int = 16
    dim: int = 16
    epochs: int = 12
    rate: float = 0.5
    held_part: float = 0.2
    accuracy: float = 0.995
    seed: int = 7


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # a row per bucket: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float


_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text between boundaries; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[codes]
    if not letter.any():
        return np.empty(0, np.uint32)
    codes = np.concatenate(([SPACE], np.where(letter, codes, SPACE), [SPACE])).astype(np.uint32)
    blank = codes == SPACE
    return codes[~(blank & np.concatenate(([False], blank[:-1])))]


def _buckets(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    n = len(codes) - order + 1
    h = np.full(max(n, 0), order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ codes[k:k + n]) * MIX[k]
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and how often each occurs."""
    codes = symbols(text)
    found = [_buckets(codes, k, bits) for k in ORDERS if len(codes) >= k]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint32),) * 2


FEATURES = pa.schema([("lang", pa.string()), ("ids", pa.binary()), ("counts", pa.binary())])


def _featurize(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t, bits) for t in texts(batch.column(0))]
        yield emit(FEATURES, [batch.column(1), [i.astype(np.uint32).tobytes() for i, _ in rows],
                              [c.astype(np.float32).tobytes() for _, c in rows]])


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], settings: Settings) -> Model | None:
    """Fit the model to (language, buckets, counts) rows; None without any."""
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    y = np.array([languages.index(r[0]) for r in rows])
    bags = [(ids.astype(np.int64), (c / c.sum()).astype(np.float32)) for _, ids, c in rows]
    draw = np.random.default_rng(settings.seed)
    order = draw.permutation(len(rows))
    held = order[:int(len(rows) * settings.held_part)]
    fitted = order[len(held):]
    table = draw.normal(0, 1, (1 << settings.bucket_bits, settings.dim)).astype(np.float32)
    weights = np.zeros((settings.dim, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps = settings.epochs * len(fitted)
    step = 0
    for _ in range(settings.epochs):
        for i in draw.permutation(fitted):
            rate = settings.rate * (1 - step / steps)
            step += 1
            ids, share = bags[i]
            mean = share @ table[ids]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = weights @ p
            weights -= rate * np.outer(mean, p)
            bias -= rate * p
            table[ids] -= (rate * len(ids) ** 0.5) * np.outer(share, back)
    logits = table @ weights
    held = held if len(held) else fitted
    z = np.array([bags[i][1] @ logits[bags[i][0]] + bias for i in held])
    temperature, reject = _calibrate(z, y[held], settings.accuracy)
    return Model(languages, np.ascontiguousarray(logits), bias, temperature, reject)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _calibrate(z: np.ndarray, y: np.ndarray, accuracy: float) -> tuple[float, float]:
    """The temperature of least loss, and the lowest score whose accepted rows are accurate enough."""
    grid = np.geomspace(0.25, 16, 49)
    losses = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-9).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    p = _softmax(z / temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = (p.argmax(axis=1) == y)[order]
    good = np.flatnonzero(np.cumsum(right) / np.arange(1, len(y) + 1) >= accuracy)
    return temperature, float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0


def fit(documents: DataFrame, settings: Settings | None = None) -> Model | None:
    """Train on a bounded sample of ``documents`` (doc_id, text, lang) with a language."""
    ship_package(documents.sparkSession)
    settings = settings or Settings()
    bits = settings.bucket_bits
    known = documents.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    chosen = sample_ids(known, "doc_id", settings.rows)
    rows = known.join(F.broadcast(chosen), known["doc_id"].eqNullSafe(chosen["_sampled"]), "left_semi")
    found = rows.select("text", "lang").mapInArrow(
        tidy(lambda batches: _featurize(batches, bits)), "lang string, ids binary, counts binary")
    # A repeated id could bring more rows than ids: the bound holds for rows as well.
    got = found.limit(settings.rows).collect()
    return train(sorted(((r[0], np.frombuffer(r[1], np.uint32), np.frombuffer(r[2], np.float32))
                         for r in got), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes())), settings)


def scores(batch: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Language probabilities of each text, and whether it has a letter."""
    width = len(model.languages)
    bits = (len(model.logits) - 1).bit_length()
    parts = [symbols(t) for t in batch]
    lengths = np.array([len(p) for p in parts])
    codes = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    sums = np.zeros((len(batch), width))
    counts = np.zeros(len(batch))
    size = max(1, CELLS // width)
    for low in range(0, len(codes), size):
        high = min(low + size, len(codes))
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
        inside = [i for i in range(first, last) if lengths[i]]
        cuts = np.maximum(starts[inside], low) - low
        for k in ORDERS:
            ids = _buckets(codes[low:high + k - 1], k, bits)
            part = model.logits[ids]
            for back in range(1, k):  # n-grams that would reach into the next text
                at = ends[inside] - back - low
                part[at[(at >= 0) & (at < len(part))]] = 0
            at = cuts[cuts < len(part)]
            if len(at):
                sums[inside[:len(at)]] += np.add.reduceat(part, at, axis=0)
    for k in ORDERS:
        counts += np.maximum(lengths - k + 1, 0)
    known = lengths > 0
    z = sums / np.maximum(counts, 1)[:, None] + model.bias
    return _softmax(z / model.temperature), known


PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
                       ("score", pa.float64()), ("rejected", pa.bool_())])


def predict(documents: DataFrame, model: Model | None, parts: int = 4, held: int = 2) -> DataFrame:
    """A row per row of ``documents``: doc_id, held_out, lang_pred, score, rejected."""
    ship_package(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), fold("doc_id", parts, held).alias("held_out"), "text")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if model is None:
                n = batch.num_rows
                languages, best, rejected = [UNKNOWN] * n, np.zeros(n), [True] * n
            else:
                p, known = scores(texts(batch.column(2)), model)
                best = np.where(known, p.max(axis=1, initial=0), 0.0)
                languages = [model.languages[j] if k else UNKNOWN for j, k in zip(p.argmax(axis=1), known, strict=True)]
                rejected = (best < model.reject_below) | ~known
            yield emit(PREDICTED, [batch.column(0), batch.column(1), languages, best, rejected])

    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(documents: DataFrame, settings: Settings | None = None, parts: int = 4, held: int = 2) -> DataFrame:
    """Train on the rows outside the held fold and predict every row."""
    model = fit(documents.where(~fold("doc_id", parts, held)), settings)
    return predict(documents, model, parts, held)
