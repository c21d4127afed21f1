"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and without overlaps inside a kind;
a match that fails its check is dropped and not retried. Further spans (iban; telephone and card numbers in
other spellings; social security numbers; secrets, that is keys and tokens) need a score of ``THRESHOLD``: a prior
for the pattern, a gain for a confirmed checksum (of secrets: for the entropy and the kinds of their characters),
a gain for a cue word within ``NEARBY`` characters before them. Base spans always stay.

Scans take time in proportion to the text: patterns are anchored so that a failing run of characters is not
tried again from each of its characters, and overlaps with base spans are found by bisection.

Defined results: null text counts as empty; offsets are code points, end exclusive; rows are judged one by
one, so repeated rows, ties and extra columns change nothing; very long texts are read whole; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "card_alt", "phone_alt", "ssn", "secret")
THRESHOLD, NEARBY = 0.8, 40

_DIGIT = re.compile(r"[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD_ALT = re.compile(r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){2}\.[0-9]{1,7}(?![0-9.])")
_PHONE_ALT = re.compile(r"(?<![0-9+.])(?:\(0?[0-9]{2,4}\)\x20?|0)[0-9](?:[\x20./-]?[0-9]){6,12}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=-]{16,}")
#: What published kinds of keys begin with.
_KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "eyJ")
_CUES = {
    "iban": re.compile(r"(?i)\b(?:iban|bic|bank|banque|konto|cuenta|account|compte)\b"),
    "card_alt": re.compile(r"(?i)\b(?:card|carte|karte|tarjeta|visa|mastercard|credit)\b"),
    "phone_alt": re.compile(r"(?i)\b(?:tel|phone|telephone|téléphone|telefon|teléfono|call|fax|mobile|portable|handy)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social\s+security|tax\s+id|taxpayer)\b"),
    "secret": re.compile(r"(?i)(?<![A-Za-z])(?:tokens?|secrets?|password|passwd|credentials?|bearer|api|auth|keys?|clé|schlüssel|kennwort|clave|contraseña)(?![a-z])"),
}
#: Prior of the pattern, gain for a confirmed checksum, gain for a cue word nearby.
_SCORES = {"iban": (0.3, 0.5, 0.2), "card_alt": (0.2, 0.4, 0.3), "phone_alt": (0.5, 0.0, 0.3), "ssn": (0.3, 0.3, 0.3), "secret": (0.2, 0.4, 0.3)}
#: Bits a character that a secret has at least; that of a key with a published start is taken as it is.
ENTROPY = 3.0


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Check digits of an account number: 1 modulo 97 after rotation and with letters as 10 to 35."""
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at)  # the run before this sign isn't read again
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub(r"[\x20-]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entropy(text: str) -> float:
    """Bits a character."""
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())


def secret_like(run: str) -> bool:
    """Whether a run of characters looks drawn at random: letters and digits, and enough entropy."""
    return run[0] != "/" and "//" not in run and any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and entropy(run) >= ENTROPY


def confirmed(kind: str, found: str) -> bool | None:
    """Whether a validator confirms the span; None where the kind has none."""
    if kind == "iban":
        return mod97(found)
    if kind == "card_alt":
        digits = re.sub("[^0-9]", "", found)
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "secret":
        return secret_like(found)
    return True if kind == "ssn" else None


def extra_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score) of further spans that reach the threshold and overlap no base span."""
    out = []
    if not _DIGIT.search(text):
        return out
    starts, ends = [b for b, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for kind, pattern in zip(EXTRA_KINDS, (_IBAN, _CARD_ALT, _PHONE_ALT, _SSN, _SECRET), strict=True):
        prior, checked, cued = _SCORES[kind]
        for m in pattern.finditer(text):
            s, e = m.span()
            if kind == "secret":
                e = s + len(m.group().rstrip("=-") or m.group())
            before = bisect_left(starts, e)  # base spans that begin before the end
            if before and ends[before - 1] > s:
                continue
            ok = confirmed(kind, text[s:e])
            if ok is False:
                continue
            cue = bool(_CUES[kind].search(text, max(0, s - NEARBY), s)) or (kind == "secret" and text.startswith(_KEY_STARTS, s))
            score = prior + checked * bool(ok) + cued * cue
            if score >= THRESHOLD - 1e-9:
                out.append((s, kind, e, score))
    return out


def find_pii(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """Base spans (kind, start, end) by start and kind; all spans with scores, likewise."""
    text = text or ""
    base = base_spans(text)
    order = {k: i for i, k in enumerate((*KINDS, *EXTRA_KINDS))}
    every = [(KINDS[k], s, e, 1.0) for s, k, e in base] + [(k, s, e, x) for s, k, e, x in extra_spans(text, base)]
    every.sort(key=lambda x: (x[1], order[x[0]]))
    return [(KINDS[k], s, e) for s, k, e in base], every


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of each row: id, base count per kind, base_spans and spans as kind:start:end, n_spans, their least score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_pii(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in KINDS]
            base = pa.array([",".join(f"{k}:{s}:{e}" for k, s, e in b) for b, _ in found], pa.string())
            every = pa.array([",".join(f"{k}:{s}:{e}" for k, s, e, _ in x) for _, x in found], pa.string())
            least = pa.array([min((x[3] for x in all_), default=None) for _, all_ in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, base, every, pa.array([len(x) for _, x in found], pa.int64()), least], ["id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", "n_spans", "least_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text").mapInArrow(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, n_spans long, least_score double")


def mask(text: str | None) -> str:
    """``text`` with each span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, s, e, _ in find_pii(text)[1]:
        if s >= at:
            out += [(text or "")[at:s], f"[{kind}]"]
            at = e
    return "".join(out) + (text or "")[at:]


def base_digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
