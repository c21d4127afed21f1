"""Awkward rows that every operator must take."""

from __future__ import annotations

import random

#: Names that the operators use themselves.
CLASH = ["row", "id", "digest", "shard", "slot", "size", "quality", "position", "key", "bucket", "keep", "n", "rep", "root", "text_1", "Shard"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH if c != "Shard")


def frame(spark, rows):
    """rows: (doc_id, text, source); extra columns hold clashing names."""
    return spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in CLASH if c != "Shard"]) for r in rows], SCHEMA)


def awkward():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéçß日") for _ in range(rng.randint(1, 7)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    base = sentence(80)
    rows = [(None, None, None), (1, None, "a"), (2, "", "a"), (3, "   \t\n ", None), (4, "one two", "b"), (5, "ONE two", "b"), (6, "one TWO", "c")]
    rows += [(10 + k, "The shared line.\n" + sentence(30) + "\n  the SHARED line. ", "hot") for k in range(14)]
    rows += [(40 + k, base + " " + word(), "hot") for k in range(9)] + [(60, base, "hot"), (61, base, "a"), (61, base, "a"), (61, base, "a")]
    rows += [(70, "x" * 30_000, "b"), (71, sentence(12_000), "b"), (72, "a b c d e " * 400, "c"), (73, "É é E\x0be\x1f\x85  \x00", "c")]
    rows += [(90 + k, sentence(rng.randint(1, 60)), rng.choice("abc")) for k in range(30)]
    return rows
