"""Licence scans: identifier tags and notice phrases by an Aho-Corasick automaton, licence expressions by a shunting-yard parser.

A word is a run of ASCII letters, digits and all characters beyond ASCII; A-Z count as a-z. A batch of texts is turned into words with one
space between them, in windows of ``WINDOW`` bytes, and one automaton runs over the windows and keeps its state between
them: memory does not grow with the length of a text, and a phrase across the edge of two windows is found. Where it ends
gives its document and the number of its words, no word becomes a Python object.

``PHRASES`` are counted as places (``n_base``, ``first_word``, ``last_word``) and give the base labels. The automaton also holds
``NOTICES``, sentences and names that stand for a licence, and ``TAGS``, the words before a licence expression. Behind a tag the raw
text is read on as an expression: identifiers, ``and``, ``or``, ``with``, parentheses and ``/`` or ``,`` as they occur in package
data. The shunting-yard parser turns it into postfix order, whose evaluation gives its licences, those ``required`` whatever one
chooses (``and`` needs both sides, ``or`` only what both share), its exceptions, and ``burden``, the class of the mildest choice
(0 public domain, 1 permissive, 2 file-level copyleft, 3 copyleft, 4 network copyleft, 5 use restricted, 6 unknown). ``with`` adds an
exception, under which copyleft counts as file-level. Tags that name the standard's identifier accept any identifier; a plain
``license:`` accepts a known one only, since prose follows it as often. An expression that breaks off is read as far as it is whole.

Labels are the base labels, those of notices, and each licence of an expression (also those one may choose not to take).
``score`` is 1 - the product of (1 - ``EVIDENCE``) over the kinds of evidence a text has, 0 without any.

- NULL and empty texts have no words, no places, empty labels and score 0. Repeated rows each get their row, a NULL id
  stays NULL, an empty table gives an empty table. Overlapping places all count.
- An expression may be of any length and depth: the parser has a stack of its own and merges smaller sets into larger ones.
- A column named like the output is replaced, others pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelark.llm import text as texts

WINDOW = 1 << 20

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
"""Phrases whose places are counted, and their labels."""

NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "permission to use copy modify and distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license": "bsl-1.0",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "creative commons zero": "cc0",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution 4 0": "cc-by",
    "creative commons attribution 3 0": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "all rights reserved": "all-rights-reserved",
}
"""Sentences and names that stand for a licence, and their labels."""

TAGS = {"spdx license identifier": False, "license": True, "licence": True, "licenses": True}
"""Words before an expression, and whether only known identifiers are accepted behind them."""

# Label and class of licence identifiers, without the version.
KNOWN = {
    "0bsd": ("0bsd", 0), "cc0": ("cc0", 0), "unlicense": ("unlicense", 0), "wtfpl": ("wtfpl", 0),
    "mit": ("mit", 1), "mit-0": ("mit", 1), "x11": ("mit", 1), "expat": ("mit", 1), "isc": ("isc", 1), "zlib": ("zlib", 1),
    "apache": ("apache-2", 1), "bsd-2-clause": ("bsd", 1), "bsd-3-clause": ("bsd", 1), "bsd-4-clause": ("bsd", 1), "bsd": ("bsd", 1),
    "bsl": ("bsl-1.0", 1), "psf": ("psf", 1), "python": ("psf", 1), "artistic": ("artistic", 1), "cc-by": ("cc-by", 1),
    "unicode-dfs": ("unicode", 1), "ncsa": ("ncsa", 1), "postgresql": ("postgresql", 1),
    "mpl": ("mpl", 2), "epl": ("epl", 2), "cddl": ("cddl", 2), "lgpl": ("lgpl", 2), "ms-pl": ("ms-pl", 2),
    "gpl": ("gpl", 3), "eupl": ("eupl", 3), "cc-by-sa": ("cc-by-sa", 3), "gfdl": ("gfdl", 3), "osl": ("osl", 3),
    "agpl": ("agpl", 4), "sspl": ("sspl", 4),
    "cc-by-nc": ("cc-by-nc", 5), "cc-by-nd": ("cc-by-nd", 5), "cc-by-nc-sa": ("cc-by-nc-sa", 5), "cc-by-nc-nd": ("cc-by-nc-nd", 5),
    "busl": ("busl", 5), "proprietary": ("proprietary", 5),
}
UNKNOWN = 6

EVIDENCE = {"expression": 0.9, "phrase": 0.8, "notice": 0.6}
"""How surely a text with evidence of a kind is under a licence."""

_NOTICE_KIND, _PHRASE_KIND, _TAG_KIND = "notice", "phrase", "tag"
_VERSION = re.compile(r"^(.+?)-?v?[0-9]+(?:\.[0-9]+)*(?:-only|-or-later|\+)?$")
_SUFFIX = re.compile(r"(?:-only|-or-later|\+)$")
_TOKEN = re.compile(rb"[ \t]*(?:([A-Za-z0-9][A-Za-z0-9.+:-]*)|([()/,]))")
_BEHIND_TAG = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\[{]?[\"']?")

_WORD = np.zeros(256, dtype=np.uint8)  # the lower-case byte of a word, 0 for all others
_WORD[0x30:0x3A] = np.arange(0x30, 0x3A)
_WORD[0x41:0x5B] = np.arange(0x61, 0x7B)
_WORD[0x61:0x7B] = np.arange(0x61, 0x7B)
_WORD[0x80:] = np.arange(0x80, 0x100)


def label_of(identifier: str) -> tuple[str, int]:
    """Label and class of an identifier; an unknown one is its own label."""
    name = identifier.lower().strip(".-:")
    for form in (name, _SUFFIX.sub("", name)):
        if form in KNOWN:
            return KNOWN[form]
    if (found := _VERSION.match(name)) and found[1] in KNOWN:
        return KNOWN[found[1]]
    return name, UNKNOWN


@dataclass
class Value:
    """What an expression comes to. Values are merged in place, the smaller set into the larger."""

    licences: set[str]
    required: set[str]
    exceptions: set[str]
    burden: int


_BINDS = {"or": 1, "and": 2, "with": 3}
_FILE_LEVEL, _COPYLEFT = 2, (3, 4)


def _united(a: set[str], b: set[str]) -> set[str]:
    small, large = sorted((a, b), key=len)
    large |= small
    return large


def _combined(operator: str, left: Value, right: Value) -> Value:
    if operator == "with":  # the right side names an exception, not a licence
        left.exceptions = _united(left.exceptions, right.licences)
        left.burden = _FILE_LEVEL if left.burden in _COPYLEFT else left.burden
        return left
    both = operator == "and"
    return Value(_united(left.licences, right.licences),
                 _united(left.required, right.required) if both else left.required & right.required,
                 _united(left.exceptions, right.exceptions),
                 max(left.burden, right.burden) if both else min(left.burden, right.burden))


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operators behind their operands; ``with`` binds closest, then ``and``, then ``or``, each from the left."""
    out: list[str] = []
    waiting: list[str] = []
    for token in tokens:
        if token in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
        elif token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        else:
            out.append(token)
    return out + waiting[::-1]


def evaluate(tokens: list[str]) -> Value:
    """The value of an expression that is whole."""
    held: list[Value] = []
    for token in postfix(tokens):
        if token in _BINDS:
            right, left = held.pop(), held.pop()
            held.append(_combined(token, left, right))
        else:
            label, burden = label_of(token)
            held.append(Value({label}, {label}, set(), burden))
    return held[0]


def expression_at(data, at: int, end: int, only_known: bool) -> list[str]:
    """The tokens of the longest whole expression that begins at byte ``at``; none if there is none."""
    tokens: list[str] = []
    open_at: list[int] = []
    whole, operand = 0, True  # tokens up to ``whole`` are an expression; whether an operand is due
    while found := _TOKEN.match(data, at, end):
        at = found.end()
        if found[1] is not None:
            word = found[1].decode("ascii")
            trimmed = word.rstrip(".:-,")
            name = trimmed.lower()
            if not operand:
                if name not in _BINDS or trimmed != word:
                    break
                tokens.append(name)
                operand = True
                continue
            if name in _BINDS or not trimmed or (only_known and tokens[-1:] != ["with"] and label_of(name)[1] == UNKNOWN):
                break
            tokens.append(name)
            operand = False
            if not open_at:
                whole = len(tokens)
            if trimmed != word:  # the sentence ends here
                break
        elif found[2] == b"(" and operand and tokens[-1:] != ["with"]:
            open_at.append(len(tokens))
            tokens.append("(")
        elif found[2] == b")" and not operand and open_at:
            open_at.pop()
            tokens.append(")")
            if not open_at:
                whole = len(tokens)
        elif found[2] in (b"/", b",") and not operand:  # MIT/Apache-2.0 means a choice
            tokens.append("or")
            operand = True
        else:
            break
    return tokens[:whole]


@lru_cache(maxsize=4)
def _automaton(phrases: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...], tags: tuple[tuple[str, bool], ...]):
    import ahocorasick

    held: dict[str, list] = {}
    for kind, entries in ((_PHRASE_KIND, phrases), (_NOTICE_KIND, notices), (_TAG_KIND, tags)):
        for phrase, value in entries:
            words = phrase.split()
            held.setdefault(f" {phrase} ", []).append((kind, len(words), len(words[-1].encode()), value))
    found = ahocorasick.Automaton()
    for phrase, values in held.items():
        found.add_word(phrase.encode().decode("latin-1"), values)
    found.make_automaton()
    return found


class _Batch:
    """Numbers of words and matches of the texts of an Arrow batch."""

    def __init__(self, column: pa.Array, automaton):
        self.data, self.offsets = texts.text_bytes(pc.fill_null(column.cast(pa.large_string()), ""))
        self.words = np.zeros(len(column), np.int64)
        self.hits: list[tuple[int, int, int, list]] = []  # text, its word that ends the phrase, where that begins, values
        self._scan(automaton.iter(""))

    def _scan(self, search) -> None:
        low, last = int(self.offsets[0]), int(self.offsets[-1])
        written = 0  # bytes of all windows before, in the automaton's numbering
        before = False  # whether the byte before the window belongs to a word
        text, seen, begun = -1, 0, -1  # the text the window begins in, its words so far, where its newest begins
        while low < last:
            high = min(low + WINDOW, last)
            lowered = _WORD[self.data[low:high]]
            word = lowered != 0
            a, b = np.searchsorted(self.offsets[:-1], [low, high])
            begins = self.offsets[a:b] - low  # of texts in this window, several at one place if some are empty
            after = np.concatenate([[before], word[:-1]])
            after[begins] = False
            starts = np.flatnonzero(word & ~after)
            keep = word | after  # words and the first byte behind each
            places = np.unique(begins)
            stream = np.insert(np.where(word, lowered, np.uint8(32))[keep], np.repeat((np.cumsum(keep) - keep)[places], 3),
                               np.tile(np.frombuffer(b" \n ", np.uint8), len(places)))
            owner = np.searchsorted(begins, starts, "right") - 1  # -1: the text the window begins in
            counts = np.bincount(owner + 1, minlength=len(begins) + 1)
            if text >= 0:
                self.words[text] += counts[0]
            self.words[a:b] += counts[1:]
            search.set(stream.tobytes().decode("latin-1") + " " * (high == last), False)
            found = list(search)
            if found:
                inner = (stream != 32) & (stream != 10)
                heads = np.flatnonzero(inner & ~np.concatenate([[before], inner[:-1]]))
                firsts = np.cumsum(counts) - counts
                for at, values in found:
                    k = int(np.searchsorted(heads, at - written)) - 1  # the word of this window that ends the phrase
                    if k < 0:
                        self.hits.append((text, seen - 1, begun, values))
                    elif owner[k] < 0:
                        self.hits.append((text, seen + k, low + int(starts[k]), values))
                    else:
                        self.hits.append((a + int(owner[k]), k - int(firsts[owner[k] + 1]), low + int(starts[k]), values))
            written += len(stream)
            text, seen = (b - 1, int(counts[-1])) if b > a else (text, seen + int(counts[0]))
            begun = low + int(starts[-1]) if len(starts) else begun
            before, low = bool(word[-1]), high

    def expression(self, text: int, at: int, only_known: bool) -> list[str]:
        """The tokens of the expression that follows the tag that ends at byte ``at``."""
        end, data = int(self.offsets[text + 1]), memoryview(self.data)
        behind = _BEHIND_TAG.match(data, at, end)
        return expression_at(data, behind.end(), end, only_known) if behind else []


FOUND = ("struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: string, labels: string, score: double, "
         "expressions: array<struct<expression: string, licences: array<string>, required: array<string>, "
         "exceptions: array<string>, burden: int>>>")


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None,
         tags: dict[str, bool] | None = None, out: str = "licence") -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_base, first_word, last_word, base_labels, labels, score and expressions."""
    named = [tuple((PHRASES if phrases is None else phrases).items()), tuple((NOTICES if notices is None else notices).items()),
             tuple((TAGS if tags is None else tags).items())]
    strings = pa.list_(pa.string())
    expression = pa.struct([("expression", pa.string()), ("licences", strings), ("required", strings), ("exceptions", strings),
                            ("burden", pa.int32())])

    @F.arrow_udf(FOUND)
    def scanned(column: pa.Array) -> pa.Array:
        batch = _Batch(column, _automaton(*named))
        rows = len(column)
        base = np.zeros(rows, np.int64)
        first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
        labels: dict[int, set[str]] = {}
        of_base: dict[int, set[str]] = {}
        kinds: dict[int, set[str]] = {}
        expressions: list[list[dict]] = [[] for _ in range(rows)]
        for at, word, begun, values in batch.hits:
            for kind, words, width, value in values:
                if kind == _TAG_KIND:
                    tokens = batch.expression(at, begun + width, value)
                    if not tokens:
                        continue
                    come = evaluate(tokens)
                    expressions[at].append({"expression": " ".join(tokens), "licences": sorted(come.licences), "burden": come.burden,
                                            "required": sorted(come.required), "exceptions": sorted(come.exceptions)})
                    labels.setdefault(at, set()).update(come.licences)
                    kinds.setdefault(at, set()).add("expression")
                    continue
                labels.setdefault(at, set()).add(value)
                kinds.setdefault(at, set()).add(kind)
                if kind == _PHRASE_KIND:
                    of_base.setdefault(at, set()).add(value)
                    start = word - words + 1
                    base[at] += 1
                    first[at], last[at] = min(first[at], start), max(last[at], start)
        score = np.zeros(rows)
        for at, own in kinds.items():
            score[at] = 1 - np.prod([1 - EVIDENCE[k] for k in sorted(own)])
        return pa.StructArray.from_arrays(
            [pa.array(batch.words), pa.array(base), pa.array(first, mask=base == 0), pa.array(last, mask=base == 0),
             pa.array([",".join(sorted(of_base.get(n, ()))) for n in range(rows)], pa.string()),
             pa.array([",".join(sorted(labels.get(n, ()))) for n in range(rows)], pa.string()), pa.array(score),
             pa.array(expressions, pa.list_(expression))],
            names=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"])

    return docs.withColumn(out, scanned(F.col(text).cast("string")))


def licence_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_expressions and burden, that of
    its strictest expression (NULL without one)."""
    found = scan(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), out="licence", **options)
    return found.select("doc_id", "licence.*").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.size("expressions").cast("long").alias("n_expressions"), F.array_max("expressions.burden").alias("burden"))
