"""Small tables with every odd case, and plain versions to compare with."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ("the of and river stone light under morning paper window table engine market seven colour winter "
         "garden number bridge letter system metal forest island copper").split()


def sentence(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(words))


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCUMENTS)


def odd_rows(seed: int = 1, plain: int = 40) -> list[tuple]:
    """Documents with NULLs in any column, empty and long texts, ties and repeated rows."""
    rng = random.Random(seed)
    rows = [(n, sentence(rng, rng.randrange(1, 120)), "en" if n % 3 else None, f"s{n % 4}") for n in range(plain)]
    rows += [(100, None, "en", "s0"), (101, "", "de", None), (102, " \n\t ", None, "s1"), (103, "one", "de", "s1"),
             (104, "!!! ??? 123", "en", "s2"), (105, sentence(rng, 30_000), "en", "s3"), (106, "x" * 50_000, "fr", ""),
             (107, rows[3][1], "en", "s0"), (108, rows[3][1].upper(), "en", "s0"), (109, rows[5][1], None, None),
             rows[7], rows[7], (None, rows[8][1], "en", "s1"), (None, None, None, None), (110, "été \U0001f600 中文", "fr", "s9")]
    return rows


def clashing(docs: DataFrame, *names: str) -> DataFrame:
    return docs.withColumns({n: F.lit(f"own {n}") for n in names})


def shingles(text: str | None, size: int = 5) -> frozenset[str]:
    """Five-word shingles the plain way."""
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in (text or "").lower()).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))
