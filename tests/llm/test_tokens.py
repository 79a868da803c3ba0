import hashlib
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from heddle.llm import bpe, context_coder, token_count, token_io
from heddle.llm.common import Recent

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(PATH)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TEXTS = st.text(st.one_of(st.sampled_from(" \n\t 　\x1c\x85ab'stIé漢🙂1,.!▁"), st.characters(exclude_categories=["Cs"])), max_size=60) | st.just("a<|endoftext|> b")


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_bpe_like_the_library(text):
    c = bpe.coder(PATH)
    ids = c.encode(text)
    assert ids == ids_of(text)
    assert c.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_table_of_two_generations():
    made = []
    table = Recent(6, lambda k: made.append(k) or len(k))
    for i in range(40):
        assert table["often"] == 5 and table["x" * i] == i
        assert len(table) <= 3 and len(table.old) <= 3
    assert made.count("often") == 1  # what is looked up again and again stays
    assert table["y" * 300] == 300 and "y" * 300 not in table


@given(st.text("abcéÿ ªßÀ×÷ŀ", max_size=8))
def test_letters_are_one_pre_token(chunk):
    c = bpe.coder(PATH)
    if bpe.letters(chunk):
        assert c.pre(chunk) == [chunk] and c.pre(" " + chunk) == [" " + chunk]


def test_merges_of_long_pre_tokens_like_the_library():
    for text in ("ab" * 3000, "the" * 2000, "=" * 5001, "aaab" * 1500 + "é" * 999):
        assert bpe.coder(PATH).merge(text.encode()) == ids_of(text)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_decode_any_ids_like_the_library(ids):
    assert bpe.coder(PATH).decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@example("▁ ▁ ▁")
@example("▁▁ ▁")
@example("▁ ▁")
@example("a ▁ ▁ b")
@example("bar ▁▁▁▁ ▁▁▁ chart")
@example("▁")
@example(" ▁")
@example("a▁ b")
@example("a ▁b")
@given(TEXTS)
def test_piece_counts_like_the_library(text):
    assert token_count.counter(PIECES).text(text, {}) == len(MODEL.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_library_encoder_with_cache(texts):
    found = token_io.LibraryEncoder(PATH, most=10).texts(pa.array(texts, pa.string()))
    assert [x.tolist() for x in found] == [ids_of(t) for t in texts]


def test_pre_tokens_go_to_the_library_once():
    encoder = token_io.LibraryEncoder(PATH)
    asked = []
    merged = encoder.merged
    encoder.merged = lambda pretokens: asked.extend(pretokens) or merged(pretokens)
    texts = ["Tiou anonth, anonth. (anonth) anonth", "a anonth; anonth\nanonth anonth's anonth. 12"]
    for _ in range(2):
        found = encoder.texts(pa.array(texts, pa.string()))
        assert [x.tolist() for x in found] == [ids_of(t) for t in texts]
    assert asked.count(" anonth") == 1 and len(asked) == len(set(asked))


def test_round_trip_query(docs, no_docs, corpus):
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect()}
    want = set()
    for i, t, _ in corpus:
        ids = ids_of(t)
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert found == want
    assert bpe.round_trip(no_docs, PATH).count() == 0
    encoded = bpe.encode(docs, PATH)
    assert {(r.doc_id, r.text) for r in bpe.decode(encoded, PATH).collect()} == {(i, t or "") for i, t, _ in corpus}


def test_token_counts(docs, no_docs, corpus):
    found = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(docs, PIECES, limit=100, table_size=50).collect())
    assert found == sorted((-1 if i is None else i or -1, len((t or "").encode()), n := len(MODEL.encode(t or "")), n > 100) for i, t, _ in corpus)
    assert token_count.token_counts(no_docs, PIECES).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 700), st.sampled_from([1, 2, 5, 300, 5000, 65536]), st.integers(0, 99))
def test_range_coder_round_trip(n, length, high, seed):
    blocks = np.random.default_rng(seed).integers(0, high, (n, length))
    tables = context_coder.Tables.of(blocks.reshape(-1), length, least=2, context_least=4)
    sent, size = context_coder.Tables.from_bytes(tables.to_bytes() + b"more")
    assert size == len(tables.to_bytes()) and all((a == b).all() for a, b in zip(tables.parts, sent.parts))
    assert (context_coder.decode_blocks(context_coder.encode_blocks(blocks, tables), length, sent) == blocks).all()


def test_range_coder_learns_repeats():
    block = np.tile(np.random.default_rng(1).integers(0, 50_000, 64), 64)[None, :]
    tables = context_coder.Tables.of(block.reshape(-1), block.size, least=10**9)  # order 0 alone, and order 2
    assert len(context_coder.encode_blocks(block, tables)[0]) < block.size * 2 * 0.1


def test_range_coder_adapts_order_zero():
    """Ids that no context foretells, each block from its own eighth of all ids: under the 12 bits that they take together."""
    rng = np.random.default_rng(5)
    blocks = rng.integers(0, 512, (16, 4096)) + 512 * (np.arange(16) % 8)[:, None]
    tables = context_coder.Tables.of(blocks.reshape(-1), 4096, least=10**9)
    sent = context_coder.encode_blocks(blocks, tables)
    assert 8 * sum(map(len, sent)) < 10.5 * blocks.size
    assert (context_coder.decode_blocks(sent, 4096, tables) == blocks).all()


def test_range_coder_mixes_orders():
    """An id follows the one before by its table or is any id, in equal parts: the mixture comes within 3 % of the entropy."""
    rng = np.random.default_rng(7)
    x = np.zeros(120_000, dtype=np.int64)
    by_table, after, other = rng.random(len(x)) < 0.5, rng.integers(0, 4, len(x)), rng.integers(0, 64, len(x))
    for k in range(1, len(x)):
        x[k] = (5 * x[k - 1] + 7 * after[k]) % 64 if by_table[k] else other[k]
    tables = context_coder.Tables.of(x, 4000)
    sent = context_coder.encode_blocks(x.reshape(-1, 4000), tables)
    likely, rest = 0.5 / 4 + 0.5 / 64, 0.5 / 64
    entropy = -(4 * likely * np.log2(likely) + 60 * rest * np.log2(rest))
    assert 8 * sum(map(len, sent)) < 1.03 * entropy * len(x)
    assert (context_coder.decode_blocks(sent, 4000, tables).reshape(-1) == x).all()


def test_files_are_smaller_than_order_zero(corpus):
    """At most 0.9 of the entropy of the ids taken one by one, tables and index included, on a text of 60,000 ids."""
    rng = np.random.default_rng(3)
    words = [rng.integers(1, 3000, rng.integers(2, 6)) for _ in range(800)]  # words of several ids
    ids = np.concatenate([words[k] for k in rng.zipf(1.3, 40_000) % 800])[:60_000].astype(np.uint16)
    n = np.bincount(ids)
    p = n[n > 0] / len(ids)
    data = token_io.file_bytes(0, 0, [1], [len(ids)], ids, 0)
    assert 8 * len(data) < 0.9 * len(ids) * -(p * np.log2(p)).sum()
    assert (token_io.read_file(data)[3] == ids).all()


def test_files(spark, docs, no_docs, corpus, tmp_path):
    rows = token_io.write_and_read(docs, PATH, f"file://{tmp_path}/t").collect()
    kept = sorted(((i is not None, i or 0), [*ids_of(t), 0]) for i, t, _ in corpus)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.ids_crc32) for r in rows) == sorted((k, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for k, x in kept)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *accumulate(r.n_tokens for r in ordered)][:-1]
    assert [r.doc_id for r in ordered] == [*(None for i, _, _ in corpus if i is None), *sorted(i for i, _, _ in corpus if i is not None)]
    assert token_io.write_and_read(no_docs, PATH, f"file://{tmp_path}/e").count() == 0
    back = token_io.read_index(spark, f"file://{tmp_path}/t", with_ids=True).filter("doc_id = 500").first()
    assert back.ids == [*ids_of(next(t for i, t, _ in corpus if i == 500)), 0]


def test_damage_is_found():
    data = bytearray(token_io.file_bytes(0, 0, [1], [5], np.array([1, 2, 3, 4, 0], dtype=np.uint16), 0))
    assert token_io.read_file(bytes(data))[3].tolist() == [1, 2, 3, 4, 0]
    data[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_io.read_file(bytes(data))
