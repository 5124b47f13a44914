"""Chunk joins are repaired until the ids agree, whatever the tokenizer does."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer, decoders, models, pre_tokenizers

from martlens.llm import chunks, queries
from martlens.llm.pieces import PieceEncoder, crosses_words
from tests.llm.test_text_operators import HARD, as_ids, prose


@pytest.fixture(scope="module")
def pieces():
    return PieceEncoder(queries.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.VOCABULARY)


def parts_of(text):
    data = text.encode()
    borders = chunks.cuts(data)
    return [data[a:b] for a, b in zip(borders, borders[1:])]


@pytest.mark.parametrize("share", [1.0, 0.5, 0.1])
def test_any_shared_chunks_give_the_ids_of_the_library(pieces, library, share):
    rng = random.Random(11)
    texts = [
        "".join(rng.choice([*HARD, prose(i, 300), "x" * 900, "語" * 900, "a b " * 300, "\n\n"]) for _ in range(8))
        for i in range(40)
    ]
    shared = {
        chunks.chunk_key(part): pieces.encode(part.decode())
        for text in texts for part in parts_of(text) if rng.random() < share
    }
    coder = chunks.ChunkEncoder(pieces, shared)
    for text in texts:
        assert coder.encode(text) == as_ids(library, text)


def test_chunks_of_prose_are_reused(pieces, monkeypatch):
    """A text of shared chunks encodes little but the words around its joins."""
    text = prose(3, 6_000)
    shared = {chunks.chunk_key(p): pieces.encode(p.decode()) for p in parts_of(text)}
    coder, asked, encode = chunks.ChunkEncoder(pieces, shared), [], pieces.encode
    monkeypatch.setattr(pieces, "encode", lambda t: asked.append(len(t)) or encode(t))
    expected = encode(text)
    assert coder.encode(text) == expected and sum(asked) < 0.15 * len(text)


def test_ids_that_do_not_agree_are_not_used(pieces):
    """Chunks with ids of another splitting of their border words."""
    text = prose(4, 2_000)
    shared = {}
    for part in parts_of(text):
        ids = b"".join(pieces.encode(c) for c in part.decode())
        shared[chunks.chunk_key(part)] = ids
    assert chunks.ChunkEncoder(pieces, shared).encode(text) == pieces.encode(text)


def blank_merging_tokenizer(path):
    """A byte-level vocabulary, made by hand, that merges across blanks."""
    base = sorted(pre_tokenizers.ByteLevel.alphabet())
    merges = [("a", "Ġ"), ("aĠ", "b"), ("b", "Ġ"), ("bĠ", "bĠ"), ("a", "l"), ("al", "p")]
    tokens = base + [x + y for x, y in merges]
    tokenizer = Tokenizer(models.BPE({t: i for i, t in enumerate(tokens)}, merges))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tokenizer.decoder = decoders.ByteLevel()
    tokenizer.save(str(path))
    return tokenizer


def test_a_tokenizer_that_merges_across_blanks(tmp_path):
    """The vocabulary shows it when loaded, and texts are encoded as a whole."""
    path = tmp_path / "tokenizer.json"
    library = blank_merging_tokenizer(path)
    pieces = PieceEncoder(str(path))
    assert not pieces.breaks
    rng = random.Random(2)
    for _ in range(30):
        text = "".join(rng.choice(["a ", "b ", "a b ", "alp ", "b b b ", "x"]) for _ in range(400))
        expected = np.array(library.encode(text).ids, "<u4").tobytes()
        assert pieces.encode(text) == expected
        shared = {chunks.chunk_key(p): pieces.encode(p.decode()) for p in parts_of(text)}
        assert chunks.ChunkEncoder(pieces, shared).encode(text) == expected


def test_what_crosses_words(pieces):
    assert pieces.breaks
    for token in (b"a b", b"a ", b"\nfoo", b"  foo", b"\tx", "x ".encode()):
        assert crosses_words(token)
    for token in (b" a", b"ab", b"  ", b"\n\n", b" \n", b"\xe3\x80", "é".encode()):
        assert not crosses_words(token)
