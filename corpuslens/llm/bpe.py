"""Byte-level BPE encoding and decoding with a segment tree over adjacent pairs.

The tree's leaves hold the rank of each adjacent pair of symbols; the root yields the leftmost pair of the
lowest rank. A merge updates three leaves in logarithmic time, until no mergeable pair remains, so a run of
n bytes takes O(n log n) whatever its shape. Pieces of up to ``ARRAY_SYMBOLS`` bytes go through their trees
together: one array holds the trees of many pieces of like size, and a step takes each piece's root and
updates its leaves; longer pieces go one by one.

Texts are taken by the distinct stretches of a group of texts (``words``). The tokenizer file is a parameter and is read once in each Python worker.

Defined results: null text counts as empty and has no ids; special tokens' strings in a text become their
ids, as the library does by default; rows are encoded one by one, so ties, repeated rows and extra columns
change nothing; very long texts are taken whole, one at a time; an empty table gives an empty result. Special
tokens that hold white space are not supported.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from corpuslens.llm import words
from corpuslens.llm.words import LATIN, Runs

#: The split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of so many bytes at most share arrays, so many trees in one.
ARRAY_SYMBOLS, ARRAY_ROWS = 129, 8192
_NONE = 1 << 62


def byte_chars() -> dict[int, str]:
    """Byte to printable character, the usual table of byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    spare = 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return out


def merge_symbols(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge adjacent pairs, leftmost of the lowest rank first. merges: pair to (rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1
    while size < n - 1:
        size *= 2
    tree = [_NONE] * (2 * size)
    get = merges.get
    for i in range(n - 1):
        m = get((symbols[i], symbols[i + 1]))
        if m is not None:
            tree[size + i] = m[0] << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    nxt, prev, symbols = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low

    while tree[1] != _NONE:
        i = tree[1] & 0xFFFFFFFF
        j = nxt[i]
        symbols[i] = merges[symbols[i], symbols[j]][1]
        symbols[j] = -1
        k = nxt[i] = nxt[j]
        if k < n:
            prev[k] = i
        if j < n - 1:
            put(j, _NONE)
        m = get((symbols[i], symbols[k])) if k < n else None
        put(i, _NONE if m is None else m[0] << 32 | i)
        h = prev[i]
        if h >= 0:
            m = get((symbols[h], symbols[i]))
            put(h, _NONE if m is None else m[0] << 32 | h)
    return [s for s in symbols if s >= 0]


class ByteBPE:
    """Encoder and decoder of one tokenizer file (byte-level BPE without normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = byte_chars()
        back = {c: b for b, c in chars.items()}
        self.byte_ids = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        # the merges by pair, as arrays
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], _NONE), np.append(np.array([r for r, _ in self.merges.values()], np.int64)[order], 0)
        self.merged = np.zeros(len(spec["model"]["merges"]) + 1, np.int64)
        for rank, symbol in self.merges.values():
            self.merged[rank] = symbol
        first = self.byte_ids.repeat(256) << 32 | np.tile(self.byte_ids, 256)
        self.byte_ranks = self.ranks(first)  # of each pair of bytes
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(len(words.stretches(s)) != 1 or s[0].isspace() for s in self.special):
            raise ValueError("special tokens with white space are not supported")
        bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            bytes_of[i] = bytes(back[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            bytes_of[i] = token.encode()
        self.bytes_of = pa.array(bytes_of, pa.large_binary())
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair (first symbol << 32 | second), ``_NONE`` for pairs that don't merge."""
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def merge_pieces(self, data: np.ndarray, edges: np.ndarray) -> Runs:
        """Ids of pieces that lie end to end in ``data`` (bytes; not empty)."""
        sizes = np.diff(edges)
        # by the number of leaves: a power of two
        power = np.where(sizes > 2, np.ceil(np.log2(np.maximum(sizes - 1, 1))), 0).astype(int)
        power[sizes > ARRAY_SYMBOLS] = -1
        parts = []
        for p in np.unique(power).tolist():
            rows = np.flatnonzero(power == p)
            if p < 0:
                long = [merge_symbols(self.byte_ids[data[edges[k] : edges[k + 1]]].tolist(), self.merges) for k in rows.tolist()]
                parts.append((rows, Runs.of(np.concatenate([np.array(x, np.uint32) for x in long]), np.array([len(x) for x in long]))))
                continue
            for lo in range(0, len(rows), ARRAY_ROWS):
                some = rows[lo : lo + ARRAY_ROWS]
                parts.append((some, self._merge_rows(data, edges[some], sizes[some], 1 << p)))
        return Runs.placed(len(sizes), parts) if parts else Runs.of(np.zeros(0, np.uint32), sizes)

    def _merge_rows(self, data: np.ndarray, starts: np.ndarray, n: np.ndarray, size: int) -> Runs:
        """Merge pieces of at most size + 1 bytes; row r of each array belongs to piece r."""
        m, width = len(n), size + 1
        data = data[np.minimum(starts[:, None] + np.arange(width), len(data) - 1)].astype(np.int64)
        real = np.arange(width) < n[:, None]
        symbols = np.where(real, self.byte_ids[data], -1)
        tree = np.full((m, 2 * size), _NONE, np.int64)  # a leaf: rank << 8 | place
        ranks = self.byte_ranks[data[:, :-1] << 8 | data[:, 1:]]
        tree[:, size:] = np.where(real[:, 1:] & (ranks != _NONE), ranks << 8 | np.arange(size), _NONE)
        level = size
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        after = np.tile(np.arange(1, width + 1), (m, 1))
        before = np.tile(np.arange(-1, width), (m, 1))  # one place more, for the end
        flat_tree, flat_symbols, flat_after, flat_before = tree.ravel(), symbols.ravel(), after.ravel(), before.ravel()

        def put(base: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            """Set a leaf of each tree and update its ancestors."""
            at = leaf + size
            flat_tree[base + at] = value
            while size > 1 and at[0] > 1:  # all leaves are equally deep
                low = np.minimum(flat_tree[base + at], flat_tree[base + (at ^ 1)])
                at = at >> 1
                flat_tree[base + at] = low

        def pair_rank(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
            ranks = self.ranks(a << 32 | b)
            return np.where(ranks == _NONE, _NONE, ranks << 8 | place)

        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            root = flat_tree[rows * (2 * size) + 1]
            i, at, base, length = root & 255, rows * width, rows * (2 * size), n[rows]
            j = flat_after[at + i]
            k = flat_after[at + j]
            merged = self.merged[root >> 8]
            flat_symbols[at + i], flat_symbols[at + j], flat_after[at + i] = merged, -1, k
            flat_before[rows * (width + 1) + k] = i
            gone = j < size
            if gone.any():
                put(base[gone], j[gone], np.full(int(gone.sum()), _NONE))
            ahead = k < length
            right = pair_rank(merged, flat_symbols[at + np.minimum(k, width - 1)], i)
            put(base, i, np.where(ahead, right, _NONE))
            h = flat_before[rows * (width + 1) + i]
            has = h >= 0
            if has.any():
                put(base[has], h[has], pair_rank(flat_symbols[(at + h)[has]], merged[has], h[has]))
            rows = rows[flat_tree[base + 1] != _NONE]
        kept = symbols >= 0
        return Runs.of(symbols[kept].astype(np.uint32), kept.sum(axis=1))

    def encode_words(self, distinct: pa.StringArray) -> Runs:
        """Ids of each stretch. A run of Latin letters is one piece; the pattern splits the others."""
        plain = pc.match_substring_regex(distinct, f"^ ?[{LATIN}]+$").to_numpy(zero_copy_only=False)
        pieces = self.merge_pieces(*words.buffers(distinct.filter(pa.array(plain))))
        rest = distinct.filter(pa.array(~plain)).to_pylist()
        split: list[list[str]] = []
        for word in rest:
            own: list[str] = []
            for part in self.cut.split(word) if self.cut is not None and any(s in word for s in self.special) else [word]:
                own += [part] if part in self.special else self.find(part)
            split.append(own)
        coded = pa.array([p for own in split for p in own], pa.string()).dictionary_encode()
        parts = coded.dictionary.to_pylist()
        ids = self.merge_pieces(*words.buffers(coded.dictionary))
        for k, part in enumerate(parts):
            if part in self.special:
                ids.flat[ids.starts[k]], ids.sizes[k] = self.special[part], 1
        found = ids.take(coded.indices.to_numpy())
        ends = np.append(0, np.cumsum(found.sizes))[np.cumsum([0, *map(len, split)])]
        return Runs.placed(len(distinct), [(np.flatnonzero(plain), pieces), (np.flatnonzero(~plain), Runs.of(found.flat, np.diff(ends)))])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids begin (and the end)."""
        return words.encode(texts, self.encode_words)

    def decode_all(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """Bytes of each text."""
        if not len(ids):
            return [b""] * (len(edges) - 1)
        got = self.bytes_of.take(pa.array(ids))
        ends = np.frombuffer(got.buffers()[1], np.int64, len(ids) + 1, got.offset * 8)[edges].tolist()
        data = memoryview(got.buffers()[2])
        return [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids of a text as little-endian 32-bit numbers and as decimals joined by commas."""
        ids = self.encode_all([text or ""])[0]
        return ids.tobytes(), ",".join(map(str, ids.tolist()))

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4")
        return self.decode_all(numbers, np.array([0, len(numbers)]))[0].decode("utf-8", "replace")


_CODECS: dict[str, ByteBPE] = {}


def codec(path: str) -> ByteBPE:
    """One codec for each file and process."""
    if path not in _CODECS:
        _CODECS[path] = ByteBPE(path)
    return _CODECS[path]


def joined(ids: np.ndarray, edges: np.ndarray) -> list[str]:
    """Decimals of each text's ids, joined by commas."""
    if len(ids) > 1 << 27:  # more than a string array holds
        return [",".join(map(str, ids[a:b].tolist())) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids).cast(pa.string())), ",").to_pylist()


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode each text and decode its ids: id, n_tokens, ids_text (decimals joined by commas; kept on request), ids_sha256, decoded_sha256, round_trip."""

    def digest(raw: bytes) -> str:
        return hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            at = 0
            for texts in words.groups(batch.column(1)):
                ids, edges = bpe.encode_all(texts)
                decimals = joined(ids, edges)
                decoded = bpe.decode_all(ids, edges)
                cols = [
                    pa.array(np.diff(edges), pa.int64()),
                    pa.array([digest(x.encode()) for x in decimals], pa.string()),
                    pa.array([digest(x.decode("utf-8", "replace").encode()) for x in decoded], pa.string()),
                    pa.array([x == t.encode() for x, t in zip(decoded, texts, strict=True)], pa.bool_()),
                    pa.array(decimals if keep_ids else [None] * len(texts), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *cols], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "ids_text"])
                at += len(texts)
        pa.default_memory_pool().release_unused()  # the worker process lives on

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text").mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, ids_text string")
