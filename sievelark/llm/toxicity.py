"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window of ``WINDOW_WORDS`` words,
overlapping the next by half, is compressed with each; it is suspect if the toxic dictionary makes it shorter. Both
dictionaries share one large part and the entropy tables, trained on ordinary text, so that the two lengths differ only
by what the small own parts hold. Suspect windows are compressed once more, four words at a time and with a thorough
search; the largest difference there is the window's margin.

Most words of a toxic text are ordinary, and dictionaries of its whole windows or of the neighbours of its marked words
separate the classes worse. The toxic dictionary is therefore trained on single words, on all whose presence goes
with the label at the significance ``FALSE_SHARE``, in whatever language. The threshold of a strong margin and the
score, a logistic function of the margins of a text, are fitted on labelled rows that the dictionaries have not seen.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelark.plans.shared import write_shared

TOXIC_ROWS = 2000
ORDINARY_ROWS = 4000
"""Labelled rows of each class that the fit sees on average; drawn by the hash of the id."""

WINDOW_WORDS = 8
FINE_WORDS = 4
SUSPECT = 1
STRONGEST = 8
"""The margin that makes a window strong is chosen from 1 to this one."""

LEVEL = 5
BASE_BYTES = 32_768
OWN_BYTES = 4096
BASE_WINDOWS = 30_000
MOST_WORDS = 1000
FALSE_SHARE = 0.01
"""Share of chance findings among the characteristic words (Benjamini and Hochberg)."""

FOLDS = 3
"""One of so many parts of the labelled sample calibrates; the others train the dictionaries."""

THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")
_PAD = b" " + b"\n" * 9  # the search for matches stops eight bytes before the end
_REPEATS = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])  # fixed values: the offsets that end a dictionary's tables


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _packed(words: list[str]) -> bytes:
    return (" " + " ".join(words)).encode() + _PAD


def _trained(size: int, samples: list[bytes], **options) -> tuple[bytes, bytes]:
    """Entropy tables and content of a trained dictionary."""
    data = zstandard.train_dictionary(size, samples, **options).as_bytes()
    at = data.index(_REPEATS) + len(_REPEATS)
    return data[:at], data[at:]


def _own_part(samples: list[bytes], size: int) -> bytes:
    """Trained content, in front of it all samples the trainer left out, rarest first."""
    try:
        content = _trained(1024 + size, samples, k=32, d=6)[1]
    except (zstandard.ZstdError, ValueError):  # too few different samples to train on
        content = b""
    for sample, _ in sorted(Counter(samples).items(), key=lambda s: (-s[1], s[0])):
        if sample not in content:
            content = sample + content
    return content


def _compressor(dictionary: bytes, **parameters) -> zstandard.ZstdCompressor:
    kind = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT)
    return zstandard.ZstdCompressor(dict_data=kind, compression_params=zstandard.ZstdCompressionParameters.from_level(
        LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False,
        write_checksum=False, **parameters))


class Distance:
    """Compares window lengths under the two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        thorough = {"min_match": 4, "strategy": zstandard.STRATEGY_BTOPT, "search_log": 4, "target_length": 32}
        self.fast = _compressor(ordinary), _compressor(toxic)
        self.fine = _compressor(ordinary, **thorough), _compressor(toxic, **thorough)

    def margins(self, words: list[str]) -> list[int]:
        """The margins of all windows that are suspect."""
        ordinary, toxic = self.fast[0].compress, self.fast[1].compress
        found = []
        for at in range(0, len(words), WINDOW_WORDS // 2):  # half over the next: what saves no byte in one may in the other
            window = words[at : at + WINDOW_WORDS]
            data = _packed(window)
            if len(ordinary(data)) - len(toxic(data)) >= SUSPECT:
                found.append(max(self._fine(window[k : k + FINE_WORDS]) for k in range(len(window))))
        return found

    def _fine(self, words: list[str]) -> int:
        data = _packed(words)
        return len(self.fine[0].compress(data)) - len(self.fine[1].compress(data))

    def measures(self, text: str | None) -> list[float]:
        """The two largest margins, the number of windows, and how many windows reach each threshold."""
        words = words_of(text)
        top = sorted(self.margins(words), reverse=True) + [0, 0]
        return [max(top[0], 0), max(top[1], 0), len(words) / WINDOW_WORDS, *(sum(m >= k for m in top) for k in range(1, STRONGEST + 1))]


def features(measures: np.ndarray, strong: int) -> np.ndarray:
    """Of each text: both margins, strong windows, windows, whether one is strong, and the share of strong ones."""
    measures = measures.reshape(-1, 3 + STRONGEST)
    windows, hits = measures[:, 2], measures[:, 2 + strong]
    return np.column_stack([measures[:, :2], np.log1p(hits), np.log1p(windows), measures[:, 0] >= strong, hits / (windows + 4)])


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray  # of the features, then the constant
    strong: int

    def score(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(measures, self.strong) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def logistic(features: np.ndarray, labels: np.ndarray, penalty: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights by Newton's method, with a small penalty on all but the constant."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-9])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)),
                               x.T @ (p - labels) + ridge @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scores(docs: DataFrame, distance: tuple[bytes, bytes], text: str, out: str) -> DataFrame:
    """``docs`` with the measures of each text as an array ``out``."""
    sent = docs.sparkSession.sparkContext.broadcast(distance)

    @F.arrow_udf("array<double>")
    def measured(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Distance(*sent.value)
        for column in columns:
            yield pa.array([own.measures(t) for t in column.to_pylist()], pa.list_(pa.float64()))

    return docs.withColumn(out, measured(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def sample_labelled(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
                    toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, seed: int = 2) -> DataFrame | None:
    """doc_id, toxic and text of about so many labelled rows of each class, written once; None without both classes.

    Labels are reduced to one row a document (toxic wins) and sampled by the hash of the id before any text is read.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic"))
    known = known.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().filter("toxic IN (0, 1)").collect()}
    if len(counts) < 2:
        return None
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    limit = F.when(F.col("toxic") == 1, toxic_rows / counts[1]).otherwise(ordinary_rows / counts[0])
    chosen = write_shared(known.filter(F.col("toxic").isin(0, 1) & (share < limit)), "labels")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return write_shared(own.join(F.broadcast(chosen), "doc_id"), "labelled")


def characteristic_words(sample: DataFrame) -> list[tuple[str, int]]:
    """Words whose presence goes with the toxic label, with their numbers of toxic texts.

    The log-likelihood ratio of a word is tested against chi-square with one degree of freedom; the words admitted are the
    most for which ``FALSE_SHARE`` of them is no less than what chance would give among all words.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    sizes = sample.groupBy().agg(F.sum("toxic").alias("nt"), F.sum(1 - F.col("toxic")).alias("no"))
    seen = write_shared(sample.select("toxic", F.explode(tokens).alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")), "words")
    tested = seen.count()
    n = sizes.first()
    nt, no = float(n.nt), float(n.no)

    def part(seen_here, group: float, present):
        return F.when(seen_here > 0, 2 * seen_here * F.log(seen_here * (nt + no) / (group * present))).otherwise(0.0)

    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    ratio = part(a, nt, a + b) + part(b, no, a + b) + part(nt - a, nt, nt + no - a - b) + part(no - b, no, nt + no - a - b)
    ranked = seen.filter(a / nt > b / no).withColumn("ratio", ratio).orderBy(F.desc("ratio"), "word").limit(MOST_WORDS)
    found = ranked.collect()
    chance = [math.erfc(math.sqrt(max(r.ratio, 0) / 2)) * tested for r in found]
    admitted = max((k for k, p in enumerate(chance, 1) if p <= FALSE_SHARE * k), default=0)
    return [(r.word, r.a) for r in found[:admitted]]


def calibrated(measures: np.ndarray, labels: np.ndarray) -> tuple[int, np.ndarray]:
    """The threshold of a strong margin with the least log loss, and the weights of its features."""
    best = None
    for strong in range(1, STRONGEST + 1):
        x = features(measures, strong)
        weights = logistic(x, labels)
        p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
        loss = -np.mean(np.log(np.where(labels == 1, p, 1 - p)))
        if best is None or loss < best[0] - 1e-9:
            best = loss, strong, weights
    return best[1:]


def _folds(sample: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows that train the dictionaries and those that calibrate; all rows for both where a part lacks a class."""
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(FOLDS)) == 0
    parts = sample.filter(~fold), sample.filter(fold)
    kinds = {(r.fold, r.toxic) for r in sample.select(fold.alias("fold"), "toxic").distinct().collect()}
    return parts if len(kinds) == 4 else (sample, sample)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", seed: int = 2, **options) -> Model | None:
    """Dictionaries, threshold and weights from a bounded sample of the labelled rows; None if a class is missing.

    What reaches the driver is bounded: ``MOST_WORDS`` words, ``BASE_WINDOWS`` windows and eleven figures a sampled row.
    """
    sample = sample_labelled(docs, labels, text, seed=seed, **options)
    if sample is None or not {r.toxic for r in sample.select("toxic").distinct().collect()} >= {0, 1}:
        return None
    learned, tested = _folds(sample, seed)
    marked = characteristic_words(learned)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = [w[k : k + WINDOW_WORDS] for t in batch.column(0).to_pylist() for w in [words_of(t)]
                       for k in range(0, len(w), WINDOW_WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(w) for w in windows], pa.string())], names=["window"])

    windows = write_shared(learned.filter("toxic = 0").select("text").mapInArrow(cut, "window string"), "windows")
    total = max(1, windows.count())
    share = F.pmod(F.xxhash64(F.lit(seed), "window"), F.lit(1 << 40)) / float(1 << 40)
    chosen = sorted(r.window for r in windows.filter(share < BASE_WINDOWS / total).limit(2 * BASE_WINDOWS).collect())
    draw = random.Random(seed)
    draw.shuffle(chosen)
    toxic = [f" {w} ".encode() for w, n in marked for _ in range(n)]
    draw.shuffle(toxic)
    ordinary = [f" {draw.choice(w.split())} ".encode() for w in chosen if w]
    base = [w.encode() for w in chosen]
    try:
        tables, shared = _trained(BASE_BYTES, base)
    except (zstandard.ZstdError, ValueError):  # a tiny sample: tables of a made-up text, content as it is
        tables = _trained(1024, [f"{k} {k * k} {k:x} {k:o}".encode() for k in range(2000)])[0]
        shared = b" ".join(base)[:BASE_BYTES] or b" " * 64
    own = _own_part(toxic, OWN_BYTES)
    other = _own_part(ordinary[: max(64, 4 * len(set(toxic)))], len(own))[-len(own) :] if own else b""
    other = (b" " * len(own) + other)[-len(own) :] if own else b""
    pair = tables + shared + own, tables + shared + other
    rows = _scores(tested, pair, "text", "measures").select("doc_id", "toxic", "measures").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.measures))
    strong, weights = calibrated(np.array([r.measures for r in rows]), np.array([r.toxic for r in rows], dtype=float))
    return Model(*pair, weights, strong)


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``out``: the probability that the text is toxic.

    NULL and empty texts get the score of a text without suspect windows; without a model every score is 0. A column
    named like ``out`` is replaced; others pass through.
    """
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        own = Distance(model.toxic, model.ordinary)
        for column in columns:
            yield pa.array(model.score(np.array([own.measures(t) for t in column.to_pylist()])) if len(column) else np.zeros(0))

    return docs.withColumn(out, scored(F.coalesce(F.col(text).cast("string"), F.lit(""))))
