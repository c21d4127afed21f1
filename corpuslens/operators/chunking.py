"""Chunker: cuts a long text at separators so that chunks are even, within budget and overlap by context.

For n chunks of even size t the cost of a chunk is size_weight * ((size - t) / budget) ** 2, plus the penalty of its
end, plus context_weight times the penalty of its context's start. Size counts what is embedded: header, opening,
mark, context and body. Cut and context are chosen together, by a shortest path over (number of chunks, cut); the
least n with a feasible plan wins. A cut that can't be reached in k chunks, or from which the rest of the text doesn't
fit in n - k, is left out before costs are computed, and costs of all ends from a cut are one array operation.

Texts that fit in one chunk never leave the JVM; the others are dealt to a stated number of partitions, as a few of
them may be most of the work.

Defined results: null and empty texts have no chunks; a text for which no plan is feasible (say, without separators)
gives one row with chunk_index -1 and null body, start and end.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Separators and their penalties; characters per token (safe and median); the mark of an omission.
SEPARATORS = (("\n\n", 0.0), ("\n", 1.0), (". ", 3.0), (".", 5.0), (";", 7.0), (",", 9.0))
SAFE_CHARS, MEDIAN_CHARS = 3.20, 3.41
MARK = "\n\n[…]\n\n"
#: Numbers of chunks that are tried beyond the least.
TRIES = 50


class Infeasible(ValueError):
    """No plan keeps every chunk within the budget."""


def candidates(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places just after a separator with the lowest penalty each, and both ends."""
    best: dict[int, float] = {0: 0.0, len(text): 0.0}
    for sep, penalty in SEPARATORS:
        at = text.find(sep)
        while at >= 0:
            place = at + len(sep)
            if place < len(text):
                best[place] = min(best.get(place, penalty), penalty)
            at = text.find(sep, at + 1)
    places = sorted(best)
    return np.array(places), np.array([best[p] for p in places])


def token_candidates(text: str, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The same in tokens: a place after each token whose stretch of text (up to the next one's start) holds a separator; the separator of the lowest penalty counts."""
    best = {0: 0.0, len(starts) - 1: 0.0}
    for t, (a, b) in enumerate(zip(starts[:-2], starts[1:-1], strict=True)):
        penalty = next((p for sep, p in SEPARATORS if sep in text[a:b]), None)
        if penalty is not None:
            best[t + 1] = min(best.get(t + 1, penalty), penalty)
    places = sorted(best)
    return np.array(places), np.array([best[p] for p in places])


def cheapest(places: np.ndarray, penalty: np.ndarray, n: int, budget: int, first: int, rest: int, low: int, high: int, size_weight: float, context_weight: float) -> list[tuple[int, int, int]] | None:
    """(start, end, context start) of the cheapest n chunks, or None."""
    last, size = len(places) - 1, int(places[-1])
    even = (size + first + (n - 1) * (rest + low)) / n
    most = budget - rest - low  # of the text, in a chunk with context
    if most <= 0:
        return None
    cost = np.full((n + 1, last + 1), math.inf)
    came, context = np.zeros((n + 1, last + 1), np.int64), np.zeros((n + 1, last + 1), np.int64)
    ends = slice(1, min(int(np.searchsorted(places, budget - first, "right")), last))
    cost[1, ends] = size_weight * ((first + places[ends] - even) / budget) ** 2 + penalty[ends]
    for k in range(1, n):
        # what the remaining chunks can't cover is no place to be
        cost[k, places < size - (n - k) * most] = math.inf
        for i in np.flatnonzero(np.isfinite(cost[k])).tolist():
            q = int(places[i])
            c0, c1 = (int(x) for x in (np.searchsorted(places, max(q - high, 0)), np.searchsorted(places, q - low, "right")))
            if q < low or c0 >= c1:
                continue
            if k + 1 == n:
                j0, j1 = last, last + 1
            else:
                need = size - (n - k - 1) * most
                j0 = max(i + 1, int(np.searchsorted(places, need)))
                j1 = min(int(np.searchsorted(places, q + most, "right")), last)
            if j0 >= j1 or (k + 1 == n and size - q > most):
                continue
            length = rest + places[None, j0:j1] - places[c0:c1, None]
            edge = size_weight * ((length - even) / budget) ** 2 + context_weight * penalty[c0:c1, None]
            edge[length > budget] = math.inf
            choice = edge.argmin(axis=0)
            total = cost[k, i] + edge[choice, np.arange(j1 - j0)] + penalty[j0:j1]
            better = np.flatnonzero(total < cost[k + 1, j0:j1])
            cost[k + 1, j0 + better], came[k + 1, j0 + better], context[k + 1, j0 + better] = total[better], i, c0 + choice[better]
    if not math.isfinite(cost[n, last]):
        return None
    out, j = [], last
    for k in range(n, 0, -1):
        i = int(came[k, j])
        out.append((int(places[i]), int(places[j]), int(places[context[k, j]]) if k > 1 else 0))
        j = i
    return out[::-1]


def chunk(text: str, header: str = "", opening: str = "", chunk_tokens: int = 8192, overlap_min: int = 125, overlap_max: int = 250, size_weight: float = 1.0, context_weight: float = 1.0, tokenizer=None) -> list[tuple[int, int, int]]:
    """(char_start, char_end, ctx_start) of each chunk: bodies tile the text, contexts reach back from their start.

    Sizes are characters at the safe rate, or tokens of ``tokenizer`` (of the tokenizers library).
    """
    if not text:
        return []
    before = f"{header}\n\n" if header else ""
    if tokenizer is None:
        starts = None
        size, count = len(text), len
        budget, low, high = int(chunk_tokens * SAFE_CHARS), int(overlap_min * MEDIAN_CHARS), int(overlap_max * MEDIAN_CHARS)
    else:
        starts = [a for a, _ in tokenizer.encode(text).offsets] + [len(text)]
        size, count = len(starts) - 1, lambda s: len(tokenizer.encode(s).ids) if s else 0
        budget, low, high = chunk_tokens, overlap_min, overlap_max
    first, rest = count(before), count(before + opening + MARK)
    if budget - first >= size:
        return [(0, len(text), 0)]
    places, penalty = candidates(text) if starts is None else token_candidates(text, starts)
    most = budget - rest - low
    least = max(2, math.ceil((size - (budget - first)) / most) + 1) if most > 0 else 9999
    # a gap that no chunk spans makes every plan infeasible
    if most > 0 and (np.diff(places).max(initial=0) <= max(most, budget - first)):
        for n in range(least, least + TRIES):
            plan = cheapest(places, penalty, n, budget, first, rest, low, high, size_weight, context_weight)
            if plan:
                return plan if starts is None else [(starts[a], starts[b], starts[c]) for a, b, c in plan]
    raise Infeasible(f"no plan for {size} units within {budget}")


def chunk_by_tokens(text: str, tokenizer, **options) -> list[tuple[int, int, int]]:
    """Chunks measured by a tokenizer of the tokenizers library."""
    return chunk(text, tokenizer=tokenizer, **options)


def embedding_text(text: str, start: int, end: int, ctx: int, index: int, header: str = "", opening: str = "") -> str:
    """What is embedded for a chunk."""
    before = f"{header}\n\n" if header else ""
    return before + (text[start:end] if index == 0 else opening + MARK + text[ctx:end])


def chars_to_tokens(chars: int, safe: bool = True) -> int:
    """Tokens that a number of characters takes: by the safe rate, or by the median one."""
    return math.ceil(chars / (SAFE_CHARS if safe else MEDIAN_CHARS))


ROWS = "doc_id long, chunk_index int, char_start int, char_end int, ctx_start int, body string"


def _long_texts(rows: DataFrame, tokenizer_file: str | None, **options) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = None
        if tokenizer_file:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(tokenizer_file)
        for frame in frames:
            for i, text in zip(frame["doc_id"], frame["text"], strict=True):
                try:
                    found = [(i, k, s, e, c, text[s:e]) for k, (s, e, c) in enumerate(chunk(text, tokenizer=tokenizer, **options))]
                except Infeasible:
                    found = [(i, -1, None, None, None, None)]
                yield pd.DataFrame(found, columns=["doc_id", "chunk_index", "char_start", "char_end", "ctx_start", "body"]).astype({c: "Int32" for c in ("char_start", "char_end", "ctx_start")})

    return rows.mapInPandas(run, ROWS)


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = 8192, overlap_min: int = 125, overlap_max: int = 250, tokenizer_file: str | None = None) -> DataFrame:
    """doc_id, chunk_index, char_start, char_end, ctx_start, body."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("length(text) > 0")
    # a token has a character at least, so that many characters fit in any case
    fits = F.length("text") <= (chunk_tokens if tokenizer_file else int(chunk_tokens * SAFE_CHARS))
    zero = F.lit(0)
    short = rows.filter(fits).select("doc_id", zero.alias("chunk_index"), zero.alias("char_start"), F.length("text").alias("char_end"), zero.alias("ctx_start"), F.col("text").alias("body"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = rows.filter(~fits).repartition(parts, F.xxhash64("doc_id", F.length("text")))
    return short.unionByName(_long_texts(long, tokenizer_file, chunk_tokens=chunk_tokens, overlap_min=overlap_min, overlap_max=overlap_max))
