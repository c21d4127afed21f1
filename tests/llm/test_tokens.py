import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuslens.llm import bpe, common, token_files, words
from tests.llm.cases import awkward, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t'abZé1²日😀! \u0085　…s")) | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text_encodes_as_the_library_does(text):
    raw, decimals = bpe.codec(PATH).encode(text)
    assert ids_of(raw) == library(text) and decimals == ",".join(map(str, library(text)))
    assert bpe.codec(PATH).decode(raw) == LIBRARY.decode(library(text), skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a<|endoftext|>b <|endoftext|> c", "x" * 20_000, " " * 500 + "a", "ab" * 9000, "<|endof", "it's we'LL 'sx"])
def test_special_and_long(text):
    assert ids_of(bpe.codec(PATH).encode(text)[0]) == library(text)


@pytest.mark.parametrize(("symbols", "rows", "group"), [(129, 8192, 2048), (3, 2, 1), (9, 5, 7)])
def test_sizes_of_arrays_and_groups_change_nothing(monkeypatch, symbols, rows, group):
    monkeypatch.setattr(bpe, "ARRAY_SYMBOLS", symbols)
    monkeypatch.setattr(bpe, "ARRAY_ROWS", rows)
    monkeypatch.setattr(words, "GROUP_ROWS", group)
    own, texts = bpe.ByteBPE(PATH), [t for _, t, _ in awkward()]
    got = []
    for some in words.groups(pa.array(texts)):
        ids, edges = own.encode_all(some)
        got += [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        assert own.decode_all(ids, edges) == [t.encode() for t in some]
    assert got == [library(t) for t in texts]


def test_words_that_only_look_alike():
    rng = random.Random(8)
    letters = "abeéÉßñÿĀɏɐ²½٣日ʰ\u0301\u00ad_09.,;:!?'\"-\n\r\t\x0b\x1c\x1f \u2003\xa0\u3000"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    enc, own = token_files.LibraryEncoder(PATH), bpe.codec(PATH)
    ids, edges = own.encode_all(texts)
    want = [library(t) for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == want
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want


def test_merge_order_is_leftmost_lowest():
    merges = {(1, 1): (0, 2), (2, 1): (1, 3), (2, 2): (2, 4)}

    def plain(symbols):
        while True:
            pairs = [(merges[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in merges]
            if not pairs:
                return symbols
            i = min(pairs)[1]
            symbols = symbols[:i] + [merges[symbols[i], symbols[i + 1]][1]] + symbols[i + 2 :]

    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([1, 1, 2, 5]) for _ in range(rng.randint(0, 20))]
        assert bpe.merge_symbols(list(s), merges) == plain(list(s))


def test_frame_round_trip(spark):
    rows = awkward()
    got = bpe.encode_decode(frame(spark, rows), PATH, keep_ids=True).collect()
    assert sorted((r.id or -1, r.n_tokens) for r in got) == sorted((i or -1, len(library(t))) for i, t, _ in rows)
    assert all(r.round_trip for r in got)
    assert bpe.encode_decode(frame(spark, rows).limit(0), PATH).count() == 0


def test_token_files_against_the_library(spark):
    rows = awkward()
    out = common.new_path(spark, "test-tokens")
    index = token_files.write_token_files(frame(spark, rows), PATH, out, length=16)
    got = token_files.read_documents(index, out).collect()
    at, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library(t), 2]
        want.append((i if i is not None else -1, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r.id if r.id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)


def test_files_hold_equal_sequences_and_masks(spark):
    rows = awkward()
    out = common.new_path(spark, "test-tokens")
    token_files.write_token_files(frame(spark, rows).coalesce(1), PATH, out, length=16)
    root, real = out.removeprefix("file://"), 0
    import pathlib

    for path in pathlib.Path(root).glob("*.arrow"):
        table = pa.ipc.open_file(pa.memory_map(str(path))).read_all()
        assert table.schema.field("ids").type == pa.list_(pa.uint16(), 16)
        mask = np.array(table.column("mask").combine_chunks().flatten())
        ids = np.array(table.column("ids").combine_chunks().flatten())
        assert not ids[~mask].any() and not (np.diff(mask.astype(int)) > 0).any()
        real += int(mask.sum())
    assert real == sum(len(library(t)) + 1 for _, t, _ in rows)
    assert not list(pathlib.Path(root).glob("_*"))


def test_no_rows_make_no_files(spark):
    assert token_files.token_file_round_trip(frame(spark, awkward()).limit(0), PATH).count() == 0


def test_library_encoder_in_small_parts(monkeypatch):
    monkeypatch.setattr(token_files, "JOINED", 3)
    enc = token_files.LibraryEncoder(PATH)
    texts = [t for _, t, _ in awkward()[:25]]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [library(t) for t in texts]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts[::-1])] == [library(t) for t in texts[::-1]]
