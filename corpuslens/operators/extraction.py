"""Extraction and linking of legal references: markers, citations, sections, outcomes, gazetteers, ranges.

Rules are data: patterns and vocabularies in tables that a user extends. A document is read once in
``extract_frame`` and all composers share that reading; linking to a catalogue is left to joins
(``operators.relational.unique_match``), which abstain on ambiguity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"(?:[LRDA]\.?\s?\*?|LO\.?\s?)?\d+(?:-\d+)*(?:\s(?:bis|ter|quater))?"
_CITATION = re.compile(rf"(?i)\barticles?\s+({_NUMBER}(?:\s*(?:,|et|ou|à)\s*{_NUMBER})*)\s+(?:du|de la|de l['’]|des)\s+((?:code|loi|décret|règlement|convention)\b[^.,;:()\n]{{0,80}})")
_SAME = re.compile(rf"(?i)\barticles?\s+({_NUMBER}(?:\s*(?:,|et|ou|à)\s*{_NUMBER})*)\s+(?:du même code|de ce code|de la même loi|dudit code)")
_BARE = re.compile(rf"(?i)\barticles?\s+({_NUMBER})")
_STEM = re.compile(r"(?i)^([a-z.\s*]*)(\d+)((?:-\d+)*)$")
# Section markers of decisions by kind, and wording of outcomes.
MARKERS = {"visa": r"(?im)^\s*vu\b", "motivations": r"(?im)^\s*(?:considérant|attendu|sur quoi)\b", "dispositif": r"(?im)^\s*(?:par ces motifs|décide\b|article 1er\s*:)"}
OUTCOMES = {"cassation": r"(?i)\bcasse et annule\b", "rejet": r"(?i)\brejette\b|\best rejetée?\b", "annulation": r"(?i)\best annulée?\b|\bannule\b", "non_lieu": r"(?i)\bnon[- ]lieu à statuer\b"}


@dataclass
class Reading:
    """What one pass over a document finds; offsets are code points, end exclusive."""

    citations: list[tuple[int, int, str, str]] = field(default_factory=list)  # start, end, instrument, article
    sections: list[tuple[str, int, int]] = field(default_factory=list)
    outcome: str | None = None


def expand(numbers: str, most: int = 50) -> list[str]:
    """Article numbers of an enumeration; "225-1 à 225-9" gives each between, up to ``most``."""
    out: list[str] = []
    parts = re.split(r"\s*(,|\bet\b|\bou\b|\bà\b)\s*", numbers.strip())
    for k in range(0, len(parts), 2):
        num = re.sub(r"\s+", " ", parts[k]).strip()
        if not num:
            continue
        if k and parts[k - 1] == "à" and out:
            a, b = re.match(r"^(.*?)(\d+)$", out[-1]), re.match(r"^(.*?)(\d+)$", num)
            if a and b and a[1].replace(" ", "") == b[1].replace(" ", "") and 0 < int(b[2]) - int(a[2]) <= most:
                out += [f"{a[1]}{n}" for n in range(int(a[2]) + 1, int(b[2]))]
        out.append(num)
    return out


def instrument_name(raw: str) -> str:
    """The cited text's name up to the first word that can't belong to it."""
    name = re.sub(r"\s+", " ", raw).strip().lower()
    return re.split(r"\s(?:et|que|qui|dans|pour|sur|ne|n'|est|sont|dispose|prévoit|applicable)\b", name)[0].strip()


def read(text: str) -> Reading:
    """Citations with their antecedents, sections and outcome of one text."""
    out, last, taken = Reading(), None, []
    found = [(m.start(), m, "full") for m in _CITATION.finditer(text)] + [(m.start(), m, "same") for m in _SAME.finditer(text)]
    for _, m, kind in sorted(found, key=lambda x: x[0]):
        if kind == "full":
            last = instrument_name(m[2])
        if last:
            out.citations += [(m.start(), m.end(), last, n) for n in expand(m[1])]
            taken.append((m.start(), m.end()))
    names = {c[2] for c in out.citations}
    if len(names) == 1:  # a bare article belongs to the only instrument that is cited
        for m in _BARE.finditer(text):
            if not any(s <= m.start() < e for s, e in taken):
                out.citations.append((m.start(), m.end(), next(iter(names)), m[1].strip()))
        out.citations.sort(key=lambda c: c[0])
    starts = sorted((m.start(), kind) for kind, p in MARKERS.items() if (m := re.search(p, text)))
    edges = [*starts, (len(text), "")]
    if starts and starts[0][0] > 0:
        out.sections.append(("preamble", 0, starts[0][0]))
    out.sections += [(kind, s, edges[k + 1][0]) for k, (s, kind) in enumerate(starts)]
    tail = text[next((s for kind, s, _ in out.sections if kind == "dispositif"), max(0, len(text) - 3000)) :]
    out.outcome = next((name for name, p in OUTCOMES.items() if re.search(p, tail)), None)
    return out


def extract_frame(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, outcome, citations and sections of each document, from one reading."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, text in zip(frame["id"], frame["text"], strict=True):
                r = read(text or "")
                rows.append((i, r.outcome, [dict(zip(("char_start", "char_end", "instrument", "article"), c, strict=True)) for c in r.citations], [dict(zip(("kind", "char_start", "char_end"), s, strict=True)) for s in r.sections]))
            yield pd.DataFrame(rows, columns=["id", "outcome", "citations", "sections"])

    schema = "id long, outcome string, citations array<struct<char_start:int,char_end:int,instrument:string,article:string>>, sections array<struct<kind:string,char_start:int,char_end:int>>"
    return docs.selectExpr(f"{id_col} AS id", f"{text_col} AS text").mapInPandas(run, schema)


# Words that tell no agreement from another.
COMMON = frozenset("de la le les des du et convention collective nationale accord".split())


def gazetteer(cited: str, names: list[str], common: frozenset[str] = COMMON) -> str | None:
    """The listed name that a citation means: its distinctive words are a subset, the closest wins, ties abstain."""
    skeleton = lambda s: frozenset(w for w in re.findall(r"\w+", s.lower()) if w not in common and len(w) > 1)
    q = skeleton(cited)
    if len(q) < 2:
        return None
    fits = sorted(((len(q & s) / len(q | s), n, s) for n in names if q <= (s := skeleton(n))), key=lambda x: (-x[0], x[1]))
    if not fits or (len(fits) > 1 and fits[0][0] == fits[1][0] and fits[0][2] != fits[1][2]):
        return None
    score, name, s = fits[0]
    return None if len(s - q) > 1 and score < 0.5 else name


def skeleton(name: Column) -> Column:
    """Distinctive words of a name, sorted."""
    words = F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*COMMON))))


def snapped(cited: DataFrame, key: str, cited_col: str, names: DataFrame, name_col: str) -> DataFrame:
    """``gazetteer`` for a table of citations and one of names: key, found. Candidates share the citation's rarest word.

    Only names that hold the rarest word can hold all, so each citation meets that word's names alone.
    """
    q = cited.select(F.col(key).alias("key"), skeleton(F.col(cited_col)).alias("q")).filter(F.size("q") >= 2)
    n = names.select(F.col(name_col).alias("name"), skeleton(F.col(name_col)).alias("s"))
    words = n.select("name", "s", F.explode("s").alias("w"))
    rare = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    first = q.select("key", "q", F.explode("q").alias("w")).join(rare, "w", "left").groupBy("key").agg(F.first("q").alias("q"), F.min_by("w", F.struct(F.coalesce("df", F.lit(0)), "w")).alias("w"))
    fits = first.join(words, "w").filter(F.size(F.array_except("q", "s")) == 0)
    score = F.size("q") / F.size(F.array_union("q", "s"))
    scored = fits.select("key", "name", "s", score.alias("score"), (F.size("s") - F.size("q")).alias("more"))
    best = scored.groupBy("key").agg(F.max_by(F.struct("name", "s", "score", "more"), F.struct("score")).alias("b"), F.max("score").alias("top"))
    ties = scored.join(best.select("key", "top"), "key").filter("score = top").groupBy("key").agg(F.countDistinct("s").alias("sets"), F.min("name").alias("name"))
    won = best.join(ties.filter("sets = 1"), "key").filter("NOT (b.more > 1 AND top < 0.5)")
    return won.select(F.col("key").alias(key), F.col("name").alias("found"))


def resolve_key(name: str) -> str:
    """Folded party name without article, legal form and "société"."""
    n = re.sub(r"[^\w\s-]", " ", name.lower())
    n = re.sub(r"\b(?:la|le|les|l|société|sociétés|sa|sas|sarl|eurl|sci|scp|selarl|sasu|snc|gie)\b", " ", n)
    return " ".join(n.split())


def domain_vote(cites: list[tuple[str, float]], strong: float = 1.0) -> str | None:
    """Domain with the greatest weight, ties by name."""
    total: dict[str, float] = {}
    for domain, w in cites:
        total[domain] = total.get(domain, 0.0) + w * strong
    return min(total, key=lambda d: (-total[d], d)) if total else None
