"""Fill-in-the-middle transformation of texts, by displacement scatter, and its inverse.

A text is cut at two code points into prefix, middle and suffix, which are put in another order between markers:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle

All texts of an Arrow batch are one run of bytes. A part moves as a whole, so the distance its bytes move is constant; it changes
only where a part begins. Those changes are entered into a difference array, whose running sum is the displacement of
every byte, and one scatter writes the batch of outputs. The way back finds the markers in the outputs, enters the changes of the
opposite displacement, and one gather reads the texts.

Both work in windows of ``WINDOW`` bytes that carry the running sum over, so besides input and output a batch needs memory for a
window, however long a text is.

Cuts and form depend on the id alone: h1 to h4 are the first four groups of eight hex digits of sha256 of ``<seed>:<id>``. A text
of n code points is cut after h1 % (n + 1) and h2 % (n + 1) of them, the smaller first.

- The form is plain, and the output the text itself, if the text is empty (NULL counts as empty) or holds a marker, or
  if h3 % 100 reaches ``share`` percent; else spm if h4 % 100 is below ``spm`` percent, else psm.
- A NULL id counts as an empty id. Repeated rows each get the same result. An empty table gives an empty table.
- A column named like an output is replaced, others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelark.llm import text as texts

SHARE, SPM, SEED = 90, 20, 1
WINDOW = 1 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_SIZE = 3  # bytes of a marker
PLAIN, PSM, SPM_FORM = 0, 1, 2
_NAMES = pa.array(["plain", "psm", "spm"])


def _leads(data: np.ndarray) -> np.ndarray:
    """Whether a code point begins at a byte."""
    return (data & 0xC0) != 0x80


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each text."""
    before, seen = np.zeros(len(offsets), np.int64), 0
    first = int(offsets[0])
    for low in range(first, int(offsets[-1]), WINDOW):
        high = min(low + WINDOW, int(offsets[-1]))
        counted = np.cumsum(_leads(data[low:high]))
        inside = (offsets > low) & (offsets <= high)
        before[inside] = seen + counted[offsets[inside] - low - 1]
        seen += int(counted[-1])
    return np.diff(before)


def byte_places(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of the byte at which code point ``wanted`` (ascending, numbered through all texts) begins."""
    places, seen = np.full(len(wanted), int(offsets[-1]), np.int64), 0
    for low in range(int(offsets[0]), int(offsets[-1]), WINDOW):
        found = np.flatnonzero(_leads(data[low : min(low + WINDOW, int(offsets[-1]))])) + low
        a, b = np.searchsorted(wanted, [seen, seen + len(found)])
        places[a:b] = found[wanted[a:b] - seen]
        seen += len(found)
    return places


def _moves(places: np.ndarray, moves: np.ndarray, low: int, high: int, carried: int) -> tuple[np.ndarray, int]:
    """Displacement of the bytes ``low`` to ``high``: the running sum of the changes entered at ``places``."""
    a, b = np.searchsorted(places, [low, high])
    changes = np.zeros(high - low, np.int64)
    changes[0] = carried
    np.add.at(changes, places[a:b] - low, moves[a:b])  # empty parts begin at one place; their changes add up
    return np.cumsum(changes), carried + int(moves[a:b].sum())


def _changes(begins: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the displacement changes and by how much, for parts that begin at ``begins`` and go to ``targets``."""
    shift = targets - begins
    return begins, np.diff(shift, prepend=0)


def scatter(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray,
            form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and limits of the outputs, for cuts at the byte places ``first`` and ``second`` of each text."""
    start, end = offsets[:-1], offsets[1:]
    moved = form != PLAIN
    limits = np.concatenate([[0], np.cumsum(end - start + 3 * _SIZE * moved)])
    out = np.empty(int(limits[-1]), np.uint8)
    own, prefix, suffix = limits[:-1], first - start, end - second
    spm = form == SPM_FORM
    p = own + _SIZE * moved + np.where(spm, suffix + _SIZE, 0)
    s = np.where(spm, own + _SIZE, own + prefix + 2 * _SIZE)
    m = own + prefix + suffix + 3 * _SIZE
    p, m, s = np.where(moved, p, own), np.where(moved, m, own + prefix), np.where(moved, s, own + (second - start))
    places, moves = _changes(np.stack([start, first, second], axis=1).ravel(), np.stack([p, m, s], axis=1).ravel())
    carried = 0
    for low in range(int(offsets[0]), int(offsets[-1]), WINDOW):
        high = min(low + WINDOW, int(offsets[-1]))
        shift, carried = _moves(places, moves, low, high, carried)
        out[np.arange(low, high) + shift] = data[low:high]
    for marker, at in ((PREFIX, p), (SUFFIX, s), (MIDDLE, m)):
        for k, byte in enumerate(marker):
            out[at[moved] - _SIZE + k] = byte
    return out, limits


def _marker_places(data: np.ndarray, limits: np.ndarray, marker: bytes, holders: np.ndarray) -> np.ndarray:
    """Place of the only marker in each text of ``holders``."""
    found = []
    for low in range(int(limits[0]), int(limits[-1]), WINDOW):
        part = data[low : min(low + WINDOW + _SIZE - 1, int(limits[-1]))]
        if len(part) >= _SIZE:
            hit = np.ones(len(part) - _SIZE + 1, dtype=bool)
            for k, byte in enumerate(marker):
                hit &= part[k : len(part) - _SIZE + 1 + k] == byte
            found.append(np.flatnonzero(hit) + low)
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    owner = np.searchsorted(limits, places, "right") - 1
    inside = np.isin(owner, holders) & (places + _SIZE <= limits[owner + 1])
    if not np.array_equal(owner[inside], holders):
        raise ValueError("an output that is not plain has to hold each marker once")
    return places[inside]


def gather(data: np.ndarray, limits: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and limits of the texts the outputs were made of."""
    start, end = limits[:-1], limits[1:]
    moved = np.flatnonzero(form != PLAIN)
    p, s, m = (_marker_places(data, limits, k, moved) for k in (PREFIX, SUFFIX, MIDDLE))
    spm = form[moved] == SPM_FORM
    prefix, suffix = np.where(spm, m, s) - p - _SIZE, np.where(spm, p, m) - s - _SIZE
    offsets = np.concatenate([[0], np.cumsum(end - start - 3 * _SIZE * (form != PLAIN))])
    begins = np.repeat(offsets[:-1, None], 3, axis=1)
    sources = np.repeat(start[:, None], 3, axis=1)
    middle = end[moved] - m - _SIZE
    begins[moved] = np.stack([offsets[moved], offsets[moved] + prefix, offsets[moved] + prefix + middle], axis=1)
    sources[moved] = np.stack([p + _SIZE, m + _SIZE, s + _SIZE], axis=1)
    places, moves = _changes(begins.ravel(), sources.ravel())
    out, carried = np.empty(int(offsets[-1]), np.uint8), 0
    for low in range(0, len(out), WINDOW):
        high = min(low + WINDOW, len(out))
        shift, carried = _moves(places, moves, low, high, carried)
        out[low:high] = data[np.arange(low, high) + shift]
    return out, offsets


def _strings(data: np.ndarray, limits: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(limits) - 1, [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(data)])


def _hash_groups(doc_id: str, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.struct(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)])


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = SHARE, spm: int = SPM,
              seed: int = SEED, out: str = "infill") -> DataFrame:
    """``docs`` with a struct ``out``: n, form, prefix_chars, middle_chars (NULL if plain) and output."""
    kind = "struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: string>"

    @F.arrow_udf(kind)
    def moved(column: pa.Array, groups: pa.Array) -> pa.Array:
        column = pc.fill_null(column.cast(pa.large_string()), "")
        data, offsets = texts.text_bytes(column)
        h = [groups.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
        n = code_points(data, offsets)
        cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)], axis=1), axis=1)
        held = pc.match_substring_regex(column, "<[PSM]>").to_numpy(zero_copy_only=False).astype(bool)
        form = np.where((n == 0) | held | (h[2] % 100 >= share), PLAIN, np.where(h[3] % 100 < spm, SPM_FORM, PSM))
        base = np.cumsum(n) - n
        at = byte_places(data, offsets, (base[:, None] + cuts).ravel()).reshape(-1, 2)
        output = _strings(*scatter(data, offsets, at[:, 0], at[:, 1], form)).cast(pa.string())
        plain = form == PLAIN
        return pa.StructArray.from_arrays(
            [pa.array(n), _NAMES.take(pa.array(form)), pa.array(cuts[:, 0], mask=plain),
             pa.array(cuts[:, 1] - cuts[:, 0], mask=plain), output],
            names=["n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.withColumn(out, moved(F.col(text).cast("string"), _hash_groups(doc_id, seed)))


def restore(docs: DataFrame, output: str | Column = "output", form: str | Column = "form", out: str = "restored") -> DataFrame:
    """``docs`` with the text that was rebuilt from output and form alone. A NULL output gives an empty text, a NULL form is plain."""

    @F.arrow_udf("string")
    def back(column: pa.Array, kinds: pa.Array) -> pa.Array:
        column = pc.fill_null(column.cast(pa.large_string()), "")
        form = pc.index_in(kinds, _NAMES).fill_null(PLAIN).to_numpy(zero_copy_only=False)
        return _strings(*gather(*texts.text_bytes(column), form)).cast(pa.string())

    return docs.withColumn(out, back(output, form))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, and sha256 of the output and of the text rebuilt from it."""
    made = transform(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), out="infill", **options)
    made = restore(made.select("doc_id", "infill.*"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))
