"""Brute-force versions, in plain Python, of what SQL cannot express."""

from __future__ import annotations

import math
import re
from collections import Counter

from corpuslens.llm import quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "n_upper": sum(c.isupper() and __import__("unicodedata").category(c) == "Lu" for c in text),
        "n_shouts": text.count("!") + text.count("?"),
        "n_function": sum(w.lower() in quality.FUNCTION_WORDS for w in words),
        "n_distinct": len(set(words)),
    }


def votes(f):
    n, chars = max(f["n_words"], 1), max(f["word_chars"], 1)

    def vote(good, bad):
        return -1 if bad else 1 if good else 0

    variety = f["n_distinct"] / min(n, math.sqrt(quality.VARIETY_WORDS * n))
    size, function = chars / n, f["n_function"] / n
    return (
        vote(f["n_words"] >= 30, f["n_words"] < 10),
        vote(3 <= size <= 9, size < 2 or size > 14),
        vote(f["n_symbols"] / n < 0.05, f["n_symbols"] / n > 0.2),
        vote(f["n_shouts"] / n < 0.05, f["n_shouts"] / n > 0.25),
        vote(f["n_upper"] / chars < 0.15, f["n_upper"] / chars > 0.4),
        vote(f["n_repeat_words"] / n <= 0.05, f["n_repeat_words"] / n > 0.2),
        vote(function >= 0.08, function < 0.02),
        vote(variety >= 0.3 and n >= 20, variety < 0.15 and n >= 50),
    )


def posteriors(patterns):
    """patterns: votes to rows; returns votes to the probability of good, by EM."""
    prior, rules = quality.PRIOR, [(quality.GOOD, quality.BAD)] * len(quality.RULES)

    def post(v):
        odds = math.log(prior / (1 - prior))
        for x, (g, b) in zip(v, rules, strict=True):
            odds += math.log(g / (1 - b)) if x == 1 else math.log((1 - g) / b) if x == -1 else 0.0
        return 1 / (1 + math.exp(-odds))

    low, high = quality.ACCURACY_RANGE
    for _ in range(quality.ROUNDS):
        weighed = [(v, n, n * post(v)) for v, n in patterns.items()]
        new = []
        for j in range(len(rules)):
            s = quality.PRIOR_VOTES
            good = (sum(g for v, _, g in weighed if v[j] == 1) + quality.GOOD * s) / (sum(g for v, _, g in weighed if v[j]) + s)
            bad = (sum(n - g for v, n, g in weighed if v[j] == -1) + quality.BAD * s) / (sum(n - g for v, n, g in weighed if v[j]) + s)
            good = min(max(good, low), high)
            new.append((good, min(max(bad, 1 - good), high)))
        s = quality.PRIOR_VOTES
        prior = min(max((sum(g for *_, g in weighed) + quality.PRIOR * s) / (sum(n for _, n, _ in weighed) + s), quality.PRIOR_RANGE[0]), quality.PRIOR_RANGE[1])
        rules = new
    return {v: post(v) for v in patterns}


def judged(texts):
    """(counts, base_failed, kept, posterior) of each text."""
    features = [counts(t) for t in texts]
    cast = [votes(f) for f in features]
    base = [f["n_words"] < 10 or 100 * f["n_repeat_words"] > 20 * f["n_words"] for f in features]
    patterns = Counter(dict.fromkeys(cast, 0))
    patterns.update(v for v, failed in zip(cast, base, strict=True) if not failed)
    model = posteriors(patterns)
    out = []
    for f, v, failed in zip(features, cast, base, strict=True):
        out.append((f, failed, not failed and model[v] >= 0.5, model[v]))
    return out


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_groups(texts):
    """Root (least place) of each text's group of links at 0.8 or more."""
    sets = [shingles(t) for t in texts]
    holders, top = {}, list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders.get(g, ()))
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
        for g in s:
            holders.setdefault(g, []).append(i)
    return [root(i) for i in range(len(texts))]


def mixed_blocks(blocks, weights):
    """Sources in the order of their blocks' slots: earliest deadline first among released blocks, slot by slot."""
    left, out = {k: n for k, n in blocks.items() if n}, []
    while left:
        names, total, ran, t = sorted(left), sum(weights[k] for k in left), dict.fromkeys(left, 0), 0
        while len(left) == len(names):
            free = [k for k in names if ran[k] * total // weights[k] <= t]
            k = min(free, key=lambda k: (-(-(ran[k] + 1) * total // weights[k]), names.index(k)))
            out.append(k)
            ran[k], left[k], t = ran[k] + 1, left[k] - 1, t + 1
            if not left[k]:
                del left[k]
    return out
