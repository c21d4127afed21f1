"""Token ids of many texts at once, by way of the distinct stretches that they are made of.

A text is cut where byte-level BPE's split pattern always cuts: where white space follows other characters, and
after a run of Latin letters that a sign of punctuation follows. Such cuts leave the pattern's pieces unchanged,
and stretches repeat: a group of texts is reduced to its distinct stretches, these are encoded, and the texts' ids
are gathered from theirs. Nothing is held beyond a group.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: The characters that Unicode calls white space; Latin letters.
_SPACE = r"\t-\r \x85\xa0  -     　"
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
#: White space and what follows it up to the next cut.
stretches = re.compile(f"[{_SPACE}]?[{LATIN}]++(?=[{_SPACE}.,;:!?])|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall
#: Texts are taken in groups of so many rows, or characters if that is less.
GROUP_ROWS, GROUP_CHARS = 2048, 8 << 20


class Runs:
    """Runs of ids: run k is ``flat[starts[k] : starts[k] + sizes[k]]``."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.flat, self.starts, self.sizes = flat, starts, sizes

    @classmethod
    def of(cls, flat: np.ndarray, sizes: np.ndarray) -> Runs:
        """Runs that lie end to end."""
        return cls(flat, np.cumsum(sizes) - sizes, sizes)

    @classmethod
    def placed(cls, n: int, parts: list[tuple[np.ndarray, Runs]]) -> Runs:
        """n runs from parts: where the runs of a part belong, and the runs."""
        starts, sizes, at = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for where, runs in parts:
            starts[where], sizes[where] = runs.starts + at, runs.sizes
            at += len(runs.flat)
        return cls(np.concatenate([r.flat for _, r in parts]), starts, sizes)

    def take(self, index: np.ndarray) -> Runs:
        """The runs of ``index``, end to end."""
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[index] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return Runs(self.flat[places], ends - sizes, sizes)


def groups(texts: pa.Array) -> Iterator[list[str]]:
    """The texts (null: empty) in their order, in groups."""
    group, held = [], 0
    for text in texts:
        text = text.as_py() or ""
        group.append(text)
        held += len(text)
        if len(group) >= GROUP_ROWS or held >= GROUP_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


def buffers(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an array of strings, and where each begins (and the end)."""
    edges = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2] if len(words) else None
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), edges


def encode(texts: list[str], encoder: Callable[[pa.StringArray], Runs]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text's ids begin (and the end). encoder: ids of each distinct stretch."""
    words, edges = [], [0]
    for text in texts:
        words += stretches(text)
        edges.append(len(words))
    coded = pa.array(words, pa.string()).dictionary_encode()
    del words
    if isinstance(coded, pa.ChunkedArray):  # more than an array holds
        coded = coded.unify_dictionaries().combine_chunks()
    runs = encoder(coded.dictionary).take(coded.indices.to_numpy())
    return runs.flat, np.append(runs.starts, len(runs.flat))[np.array(edges)]
