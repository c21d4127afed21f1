"""Operators on whole texts that need a program: snippets, differences, casing, collocations, slugs, references."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators.search import query_tokens

_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


def highlight(docs: list[tuple[int, str]], query: str, budget: int = 500) -> dict[int, str]:
    """Best fragment of each text of a page, matches marked: terms weigh 1 / (1 + texts of the page that hold them)."""
    terms = set(query_tokens(query))
    folds: dict[str, str] = {}  # a page repeats its words
    spans, held = {}, {}
    for i, text in docs:
        rows = []
        for m in _WORD.finditer(text):
            word = m.group()
            if word not in folds:
                folds[word] = query_tokens(word)[0]
            rows.append((m.start(), m.end(), folds[word]))
        spans[i], held[i] = rows, terms.intersection(w for _, _, w in rows)
    df = {t: sum(t in found for found in held.values()) for t in terms}
    out = {}
    for i, text in docs:
        if not held[i]:
            continue
        best, current, ascii_ = None, None, text.isascii()
        for s, e, w in spans[i]:
            if current is None or e - current[1] > budget or not ascii_ and len(text[current[1] : e].encode()) > budget:
                current = [0.0, s, e, []]
            current[2] = e
            if w in terms:
                current[0] += 1 / (1 + df[w])
                current[3].append((s, e))
            if current[3] and (best is None or current[0] > best[0]):
                best = [current[0], current[1], current, list(current[3])]
        if best:
            _, start, fragment, _ = best
            end, parts, at = fragment[2], [], start
            for s, e in fragment[3]:
                parts += [text[at:s], "<mark>", text[s:e], "</mark>"]
                at = e
            out[i] = "".join(parts) + text[at:end]
    return out


def diff(old: str, new: str) -> list[tuple[str, str]]:
    """Segments (equal, insert, delete): lines first, changed lines then word by word; neighbours merged.

    In long texts very frequent words only extend matches and never start them, so time stays near linear.
    """
    out: list[list[str]] = []

    def add(op: str, text: str) -> None:
        if text:
            if out and out[-1][0] == op:
                out[-1][1] += text
            else:
                out.append([op, text])

    def walk(a: list[str], b: list[str], deeper) -> None:
        for op, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes():
            if op == "equal":
                add("equal", "".join(a[i:j]))
            elif op == "replace" and deeper:
                split = lambda x: re.findall(r"\w+|\W", "".join(x))
                walk(split(a[i:j]), split(b[k:m]), None)
            else:
                add("delete", "".join(a[i:j]))
                add("insert", "".join(b[k:m]))

    walk(old.splitlines(keepends=True), new.splitlines(keepends=True), True)
    return [(op, text) for op, text in out]


def diff_frame(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, n, op, text) for k, a, b in zip(f["key"], f["old"], f["new"], strict=True) for n, (op, text) in enumerate(diff(a or "", b or ""))]
            yield pd.DataFrame(rows, columns=["key", "n", "op", "text"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(F.col(key).alias("key"), F.col(old).alias("old"), F.col(new).alias("new")).mapInPandas(run, f"key {kind}, n int, op string, text string")


def truecase(text: str, names: frozenset[str] = frozenset()) -> str:
    """Sentence case for texts in capitals; words of ``names`` keep a capital."""
    letters = [c for c in text if c.isalpha()]
    if len(letters) < 200 or sum(c.isupper() for c in letters) < 0.85 * len(letters):
        return text
    low = text.lower()
    low = re.sub(r"(^|[.!?]\s+|\n)(\w)", lambda m: m[1] + m[2].upper(), low)
    return re.sub(r"\w+", lambda m: m.group().capitalize() if m.group() in names else m.group(), low)


def collocations(tokens: list[str], lexicon: set[tuple[str, ...]]) -> list[tuple[int, int]]:
    """Leftmost-longest spans of lexicon entries, without overlaps."""
    longest = max(map(len, lexicon), default=0)
    out, i = [], 0
    while i < len(tokens):
        n = next((k for k in range(min(longest, len(tokens) - i), 0, -1) if tuple(tokens[i : i + k]) in lexicon), 0)
        if n:
            out.append((i, i + n))
        i += n or 1
    return out


def assign_slugs(titles: DataFrame, key: str, base: str, date: str) -> DataFrame:
    """A slug for each row: the base if it is alone, else with its date, else numbered from 2 by key order."""
    w = Window.partitionBy
    alone = F.count(F.lit(1)).over(w(base)) == 1
    dated = F.concat_ws("-", F.col(base), F.date_format(date, "yyyy-MM-dd"))
    rows = titles.withColumn("_s", F.when(alone, F.col(base)).otherwise(dated))
    n = F.row_number().over(w("_s").orderBy(key))
    return rows.withColumn("slug", F.when(n == 1, F.col("_s")).otherwise(F.concat_ws("-", F.col("_s"), n.cast("string")))).drop("_s")


def better_cased(a: str, b: str) -> str:
    """Of two spellings that differ in case, the one that is neither all capitals nor all small; else the first."""
    mixed = [x for x in (a, b) if x != x.upper() and x != x.lower()]
    return mixed[0] if mixed else a


def without_prefix_variants(values: list[str]) -> list[str]:
    """Values in their order, without those that another one continues (whole words, whatever the case)."""
    best: dict[str, str] = {}
    for v in values:
        best[v.casefold()] = better_cased(best[v.casefold()], v) if v.casefold() in best else v
    return [v for k, v in best.items() if not any(o != k and o.startswith(k + " ") for o in best)]
