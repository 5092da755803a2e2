"""Token ids of whole texts by a public tokenizer's vocabulary file, with pieces remembered.

The vocabulary lower-cases, folds white space and splits a text into pieces
that are encoded one by one, so a text's ids are those of its pieces.  For
texts of plain letters, digits and punctuation the pieces are found here on
bytes and each distinct piece is encoded once per worker; every other text goes
through the library whole.  Both ways give the same ids, which the tests check.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from arbora.llm import textkit

VOCABULARY = "word_bpe_49k.json"
#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 800_000
#: Bytes of text that are encoded together.
RUN = 1 << 18

#: Characters whose normal form, lower case and class are the same here and in the library.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿŒœ0-9\t\n\r !-/:-@\[-`{-~]*")

_SPACE, _WORD, _NUMBER, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _NUMBER
_CLASS[97:123] = _CLASS[0x80:] = _WORD


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of plain, lower-cased texts: letter runs, single digits, runs of other marks, and the contractions."""
    kind = _CLASS[data]
    begin = np.ones(len(data), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    text_end = np.zeros(len(data) + 4, bool)
    text_end[offsets] = True
    quote = np.flatnonzero((data == 39) & begin)
    if len(quote):
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        one, two = padded[quote + 1], padded[quote + 2]
        inside = ~text_end[quote + 1]
        short = inside & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = inside & ~text_end[quote + 2] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for at, size in ((quote[short], 2), (quote[long], 3)):
            begin[at + 1] = False
            after = at + size
            begin[after[after < len(data)]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    keep = kind[starts] != _SPACE
    return starts[keep], ends[keep]


def _agree(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether each piece has the bytes of the piece it is taken for."""
    size = ends - starts
    if not np.array_equal(size, size[like]):
        return False
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    own = np.repeat((starts - np.cumsum(size) + size).astype(kind), size) + np.arange(int(size.sum()), dtype=kind)
    here = data[own]
    own += np.repeat((starts[like] - starts).astype(kind), size)
    return np.array_equal(here, data[own])


def _extended(known: np.ndarray, more: np.ndarray) -> np.ndarray:
    """An array that nothing else refers to, with further values behind its own: it grows in place, without a second copy beside it."""
    n = len(known)
    known.resize(n + len(more), refcheck=False)
    known[n:] = more
    return known


def _bounds(known: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Ascending bounds and further ones behind them, in 32 bits while they fit."""
    return _extended(known if more[-1] < 1 << 31 else known.astype(np.int64), more)


class Encoder:
    """Ids of texts by one vocabulary file."""

    def __init__(self, path: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or vocabulary_path())
        ends = np.zeros(self.library.get_vocab_size() + 1, bool)
        for token, k in self.library.get_vocab().items():
            ends[k] = token.endswith("</w>")
        self.ends_piece = ends
        self._forget()

    def _forget(self) -> None:
        # Hashes ascending and each one's piece; a piece's ids and bytes are slices of the two flat arrays, from its bound to the next.
        self.hashes, self.piece = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.offset, self.flat = np.zeros(1, np.int32), np.zeros(0, np.uint32)
        self.begin, self.bytes = np.zeros(1, np.int32), np.zeros(0, np.uint8)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """By the library alone."""
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, raw: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        keys = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        joined = [b" ".join(keys[k : k + 500]).decode() for k in range(0, len(keys), 500)]
        ids = np.concatenate(self.whole(joined))
        last = np.flatnonzero(self.ends_piece[ids])
        if len(last) != len(keys):
            raise RuntimeError("pieces and ids do not agree")
        known = len(self.piece)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.piece = np.insert(self.piece, at, np.arange(known, known + len(keys), dtype=np.int32))
        self.offset = _bounds(self.offset, len(self.flat) + last + 1)
        self.flat = _extended(self.flat, ids)
        self.begin = _bounds(self.begin, len(self.bytes) + np.cumsum(ends - starts))
        self.bytes = _extended(self.bytes, np.frombuffer(b"".join(keys), np.uint8))

    def _remembered(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: np.ndarray) -> bool:
        """Whether pieces have the bytes of those remembered for their hashes."""
        size = ends - starts
        begin = self.begin[piece].astype(np.int64)
        if not np.array_equal(size, self.begin[piece + 1] - begin):
            return False
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return np.array_equal(data[np.repeat(starts, size) + step], self.bytes[np.repeat(begin, size) + step])

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        parts = [t.lower().encode() for t in texts]
        raw = b"".join(parts)
        data = np.frombuffer(raw, np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        starts, ends = pieces(data, offsets)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(texts)
        hashes, first, place = np.unique(textkit.hash_slices(data, starts, ends), return_index=True, return_inverse=True)
        if not _agree(data, starts, ends, first[place]):
            return self.whole(texts)
        if len(self.hashes) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != hashes[inside]
        if new.any():
            self._learn(raw, hashes[new], starts[first[new]], ends[first[new]])
            at = np.searchsorted(self.hashes, hashes)
        distinct = self.piece[at]
        if not self._remembered(data, starts[first], ends[first], distinct):
            return self.whole(texts)
        number = distinct[place]
        first = self.offset[number].astype(np.int64)
        size = self.offset[number + 1] - first
        after = np.cumsum(size, dtype=np.int64)
        ids = self.flat[np.repeat(first - after + size, size) + np.arange(after[-1])]
        cut = np.concatenate([[0], after])[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [_PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        rest = iter(self.whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        easy = iter(self._plain([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(easy) if p else next(rest) for p in plain]

    def column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column; nulls are empty texts."""
        run, held = [], 0
        for text in column:
            run.append(text.as_py() or "")
            held += len(run[-1])
            if held >= RUN:
                yield from self.encode(run)
                run, held = [], 0
        yield from self.encode(run)


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder of a vocabulary file; read on first use, on whichever machine."""
    path = path or vocabulary_path()
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]
