"""Listwise reranking of a short list: seeded shuffles in batches, mean scores, merge with the first ranking.

The scorer is a callable (query, texts) -> scores or None; without a service the lexical overlap serves.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable

DEPTH, SHUFFLES, BATCHES = 50, 3, 5


def overlap_scorer(query: str, texts: list[str]) -> list[float]:
    words = set(re.findall(r"\w+", query.lower()))
    return [100 * len(words & set(re.findall(r"\w+", t.lower()))) / (len(words) or 1) for t in texts]


def parse_scores(content: str, k: int) -> list[float] | None:
    """k scores from 0 to 100 out of a model's answer; anything else is None."""
    m = re.search(r"\[[^\[\]]*\]", content)
    try:
        values = json.loads(m.group()) if m else None
    except ValueError:
        return None
    if not isinstance(values, list) or len(values) != k or not all(isinstance(v, int | float) and not isinstance(v, bool) for v in values):
        return None
    return [min(100.0, max(0.0, float(v))) for v in values]


def rerank(items: list[tuple[int, str]], query: str, scorer: Callable[[str, list[str]], list[float] | None] = overlap_scorer) -> list[int]:
    """Ids by mean score over the shuffles, ties in their first order; a failed batch scores by first rank."""
    head = items[:DEPTH]
    total = dict.fromkeys((i for i, _ in head), 0.0)
    for seed in range(SHUFFLES):
        order = list(range(len(head)))
        random.Random(seed).shuffle(order)
        for part in (order[b::BATCHES] for b in range(BATCHES)):
            scores = scorer(query, [head[p][1] for p in part])
            if scores is None:
                scores = [100.0 * (len(head) - p) / len(head) for p in part]
            for p, s in zip(part, scores, strict=True):
                total[head[p][0]] += s / SHUFFLES
    place = {i: n for n, (i, _) in enumerate(head)}
    return sorted(total, key=lambda i: (-round(total[i], 9), place[i]))


def merge(base: list[int], new: list[int]) -> list[int]:
    """New order first, then the head's rest and the tail as they were."""
    known = set(base)
    first = [i for i in dict.fromkeys(new) if i in known]
    return first + [i for i in base if i not in set(first)]
