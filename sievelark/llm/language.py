"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the three- and four-byte grams of the lower-cased text that do not cross white space
(digits, signs and the ends of the text count as white space), hashed to ``BUCKETS`` rows. The embedding
of a text is the mean over all its grams; a linear layer and a softmax follow. Both are trained by
stochastic gradient descent in numpy on a bounded sample. As every step up to the softmax is linear, a task
carries one score for each bucket and language instead of the embeddings.

A part of the sample is held back to calibrate: the temperature that minimises its log loss, and the
confidence below which a prediction is rejected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelark.llm import text as texts

PER_LANGUAGE = 500
"""Rows of each language that the fit sees on average; the sample is drawn by the hash of the id."""

BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 12
RATE = 0.5
HELD_BACK = 0.25
TARGET_RISK = 0.01
"""Share of wrong predictions among those accepted that the rejection threshold aims at."""

LEAST_CONFIDENCE = 0.5
UNKNOWN = "und"

_MAPPED = np.full(256, 32, dtype=np.uint8)
_MAPPED[97:123] = np.arange(97, 123)
_MAPPED[128:] = np.arange(128, 256)


def _spaced(column: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.lowered(column),
                                       pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))


def _grams(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and buckets of the grams of ``width`` bytes whose inner bytes are no white space."""
    count = len(data) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = data[1 : 1 + count] != 32
    for k in range(2, width - 1):
        inner &= data[k : k + count] != 32
    places = np.flatnonzero(inner)
    key = np.full(len(places), width, dtype=np.uint64)
    for k in range(width):
        key = key << np.uint64(8) | data[places + k].astype(np.uint64)
    shift = np.uint64(64 - int(math.log2(BUCKETS)))
    return places, ((key * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def gram_groups(column: pa.Array):
    """Pieces of a text column: (number of the text, bucket) of every gram, texts ascending.

    A piece ends anywhere; the next one repeats its last three bytes, so no gram is lost or counted twice.
    """
    data, offsets = texts.text_bytes(_spaced(column))
    low, end = int(offsets[0]), int(offsets[-1])
    while low < end:
        high = min(low + texts.GROUP_BYTES, end)
        piece = _MAPPED[data[low : min(high + 3, end)]]
        for width in (3, 4):
            places, buckets = _grams(piece, width)
            here = places < high - low
            places, buckets = places[here] + low, buckets[here]
            owner = np.searchsorted(offsets, places, "right") - 1
            inside = places + width <= offsets[owner + 1]
            yield owner[inside], buckets[inside]
        low = high


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # a row for each bucket, a column for each language
    temperature: float
    threshold: float

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """Calibrated probabilities of each text; zeros if it has no gram."""
        total = np.zeros((len(column), len(self.languages)))
        count = np.zeros(len(column))
        for owner, buckets in gram_groups(column):
            if len(owner):
                starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                total[owner[starts]] += np.add.reduceat(self.scores[buckets], starts, axis=0, dtype=np.float64)
                count += np.bincount(owner, minlength=len(column))
        return softmax(total / np.maximum(count, 1)[:, None] / self.temperature) * (count > 0)[:, None]


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: int, seed: int = 4,
          epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """Scores of buckets after stochastic gradient descent over (label, buckets, shares) rows."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer = np.zeros((DIMENSIONS, languages))
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for n in rng.permutation(len(rows)):
            label, buckets, shares = rows[n]
            mean = shares @ table[buckets]
            error = softmax(mean @ layer)
            error[label] -= 1
            step = rate * (1 - done / steps)
            done += 1
            table[buckets] -= step * len(buckets) ** 0.5 * np.outer(shares, layer @ error)
            layer -= step * np.outer(mean, error)
    return (table @ layer).astype(np.float32)


def calibrate(logits: np.ndarray, labels: np.ndarray, risk: float, least: float) -> tuple[float, float]:
    """Temperature of the least log loss, and the lowest confidence with at most ``risk`` errors above it."""
    best, temperature = math.inf, 1.0
    doubt = 1 / (len(labels) + 2)  # no finite sample shows that there are no errors
    for candidate in np.geomspace(0.05, 20, 60):
        logs = np.log(softmax(logits / candidate) + 1e-12)
        loss = -((1 - doubt) * logs[np.arange(len(labels)), labels] + doubt * logs.mean(axis=1)).mean()
        if loss < best - 1e-9:
            best, temperature = loss, float(candidate)
    chance = softmax(logits / temperature)
    confidence, wrong = chance.max(axis=1), chance.argmax(axis=1) != labels
    order = np.argsort(-confidence, kind="stable")
    risks = np.cumsum(wrong[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(risks <= risk)
    accepted = float(confidence[order][good[-1]]) if len(good) else 1.0
    everything = len(good) and good[-1] == len(order) - 1
    return temperature, max(least, 0.0 if everything else accepted)


def _sparse(column: pa.Array) -> tuple[list[bytes], list[bytes]]:
    owners, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for owner, found in gram_groups(column):
        owners.append(owner)
        buckets.append(found)
    keys, counts = np.unique(np.concatenate(owners) * BUCKETS + np.concatenate(buckets), return_counts=True)
    cuts = np.searchsorted(keys, np.arange(1, len(column)) * BUCKETS)
    return ([(k % BUCKETS).astype(np.int32).tobytes() for k in np.split(keys, cuts)],
            [c.astype(np.int32).tobytes() for c in np.split(counts, cuts)])


def has_letter(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(r"\p{L}")


def fit(labelled: DataFrame, text: str = "text", language: str = "lang", doc_id: str = "doc_id",
        per_language: int = PER_LANGUAGE, seed: int = 4) -> Model | None:
    """Fit on a sample of about ``per_language`` rows of each language; None without labelled text.

    The tasks turn the sampled texts, whole, into bucket counts; only those (at most ``BUCKETS`` pairs a row)
    reach the driver, which trains. The same rows give the same model.
    """
    rows = labelled.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(language).cast("string").alias("lang"),
                           F.col(text).cast("string").alias("text")).filter(F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return None
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    limit = F.lit(0.0)
    for name, n in counts.items():
        limit = F.when(F.col("lang") == name, F.lit(per_language / n)).otherwise(limit)
    sample = rows.filter((share < limit) & has_letter("text"))

    def counted(batches):
        for batch in batches:
            buckets, times = _sparse(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(buckets, pa.binary()),
                                              pa.array(times, pa.binary())], names=["doc_id", "lang", "buckets", "times"])

    found = sample.mapInArrow(counted, "doc_id long, lang string, buckets binary, times binary").collect()
    found = sorted(((r.lang, -1 if r.doc_id is None else r.doc_id, bytes(r.buckets), bytes(r.times)) for r in found))
    number = {name: k for k, name in enumerate(languages)}
    prepared = []
    for name, _, buckets, times in found:
        own, weights = np.frombuffer(buckets, np.int32), np.frombuffer(times, np.int32).astype(np.float64)
        if len(own):
            prepared.append((number[name], own, weights / weights.sum()))
    if not prepared:
        return None
    order = np.random.default_rng(seed).permutation(len(prepared))
    back = order[: int(HELD_BACK * len(order))]
    scores = train([prepared[k] for k in order[len(back) :]], len(languages), seed)
    temperature, threshold = 1.0, LEAST_CONFIDENCE
    if len(back):
        logits = np.array([prepared[k][2] @ scores[prepared[k][1]] for k in back])
        temperature, threshold = calibrate(logits, np.array([prepared[k][0] for k in back]), TARGET_RISK, LEAST_CONFIDENCE)
    return Model(languages, scores, temperature, threshold)


def identify(docs: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out``: lang_pred, score (calibrated, 0 to 1) and accepted.

    NULL texts and texts without a letter are ``und`` with score 0 and rejected, and so is everything without a
    model. A text whose letters make no gram gets the first language with score 1 / languages. A column named like
    ``out`` is replaced; others pass through.
    """
    kind = "struct<lang_pred: string, score: double, accepted: boolean>"
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    if model is None:
        return docs.withColumn(out, none)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(kind)
    def predict(column: pa.Array) -> pa.Array:
        own = sent.value
        chance = own.probabilities(column)
        score, best = chance.max(axis=1), chance.argmax(axis=1)
        score = np.where(score > 0, score, 1 / len(own.languages))
        accepted = score >= own.threshold
        names = pa.array(own.languages, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(score), pa.array(accepted)],
                                          names=["lang_pred", "score", "accepted"])

    return docs.withColumn(out, F.when(has_letter(text), predict(F.col(text).cast("string"))).otherwise(none))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4 (false for a NULL id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows a model may learn from: not held out, and with an id."""
    return docs.filter(F.col(doc_id).isNotNull() & ~held_out(doc_id))
