"""Encoding with the tokenizers library, with results kept per word.

A byte-level tokenizer never merges across the places where this module cuts a
text: before a blank that follows and precedes other characters, and around runs
of white space. So equal pieces always have equal ids, wherever they stand. That is
checked when a vocabulary is loaded: if it has an entry with white space behind other
characters, or one that does not begin with a single blank before them, every text is
encoded as a whole.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np

# Fixed value: the characters with Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECE = re.compile(f"[{WHITE}]+(?![^{WHITE}])| ?[^{WHITE}]+|[{WHITE}]")
KEPT_PIECES = 800_000
KEPT_CHARS = 48


class PieceEncoder:
    """Ids of texts as little-endian 32-bit integers, equal to the library's."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size()
        # Vocabulary entries are written with one character per byte.
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = [_token_bytes(t) for t in tokens]
        content = set(self.special)
        self.breaks = not any(
            crosses_words(b) for t, b in zip(tokens, self.bytes) if t not in content
        )
        self.kept: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        # The fast call gives the same ids, without the places of the tokens in the text.
        (encoding,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(encoding.ids, "<u4").tobytes()

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.breaks or self.has_special(text):
            return self.whole(text)
        pieces = PIECE.findall(text)
        kept = self.kept
        missing = set(pieces).difference(kept)
        if missing and len(kept) > KEPT_PIECES:
            # Frequent pieces come early; the later ones make room.
            kept = self.kept = dict(islice(kept.items(), KEPT_PIECES // 2))
            missing = set(pieces).difference(kept)
        large = self._learn(missing)
        if large:
            return b"".join([large[p] if p in large else kept[p] for p in pieces])
        return b"".join(map(kept.__getitem__, pieces))

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Encode pieces that are not kept yet, many in one call of the library."""
        large, blank, bare = {}, [], []
        for piece in missing:
            if piece[-1:].isspace() or len(piece) == 1:
                self.kept[piece] = self.whole(piece)
            elif len(piece) > KEPT_CHARS:
                large[piece] = self.whole(piece)
            else:
                (blank if piece[0] == " " else bare).append(piece)
        # Pieces that begin with a blank can follow each other; others need a
        # line feed, a piece by itself, in between.
        for group, join in ((blank, ""), (bare, "\n")):
            if group:
                self._learn_joined(group, join)
        return large

    def _learn_joined(self, group: list[str], join: str) -> None:
        ids = np.frombuffer(self.whole(join.join(group)), "<u4")
        ends = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        sizes = np.array([len(piece.encode()) for piece in group]) + len(join)
        starts = np.cumsum(sizes) - sizes
        first = np.searchsorted(ends, starts) * 4
        last = np.searchsorted(ends, starts + sizes - len(join)) * 4
        data = ids.tobytes()
        for piece, a, b in zip(group, first.tolist(), last.tolist()):
            self.kept[piece] = data[a:b]

    def decode(self, ids: bytes) -> str:
        """As the library's decode with special tokens kept."""
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


# White space behind other characters, or before them unless it is a single blank.
_CROSSES = re.compile(f"[^{WHITE}][{WHITE}]|[{WHITE}]{{2}}[^{WHITE}]|(?! )[{WHITE}][^{WHITE}]")


def crosses_words(token: bytes) -> bool:
    """Whether a token reaches over a place where texts are cut into pieces."""
    return _CROSSES.search(token.decode("utf-8", "replace")) is not None


def _byte_characters() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTES = _byte_characters()


def _token_bytes(token: str) -> bytes:
    if all(c in _BYTES for c in token):
        return bytes(_BYTES[c] for c in token)
    return token.encode()


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of a vocabulary file; a worker process keeps it between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
