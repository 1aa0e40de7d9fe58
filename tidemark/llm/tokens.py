"""Token ids of whole texts with a public tokenizer, computed once per distinct piece of text.

A byte-level BPE splits a text before it merges bytes. A lone blank between two characters that aren't white space, a
lone newline between two such, and the places where Latin letters, digits and punctuation meet always lie on such a
split (but for apostrophes, which begin contractions, and the signs that special tokens are written with). So a text is
cut there, each distinct piece is encoded by the tokenizers library once and kept in a bounded cache, and the pieces'
ids are joined: the same ids at a fraction of the time."""

from __future__ import annotations

import functools
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import HELD, binary, raw, table_of

VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a worker keeps; beyond that it drops those that it has met in one batch only.
CACHE = 250_000
WHITE = table_of({0x20, *range(0x09, 0x0E), 0x1C, 0x1D, 0x1E, 0x1F})
#: 1 letters, 2 digits, 3 punctuation, 0 the rest.
KIND = np.zeros(256, np.uint8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
KIND[0x30:0x3A] = 2
KIND[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and chr(x) not in "'<|>"]] = 3


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str, cache: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), cache
        self.forget()

    def forget(self, again: np.ndarray | None = None) -> None:
        """Keep the pieces of again alone, or none."""
        again = np.zeros(0, np.int64) if again is None else again
        names = list(self.known) if len(again) else []
        sizes = self.sizes[again] if len(again) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.heads[again] - (ends - sizes), sizes) + np.arange(ends[-1])] if len(again) else np.zeros(0, np.uint32)
        self.known = {names[k]: i for i, k in enumerate(again.tolist())}
        self.flat, self.heads, self.sizes, self.met = flat, ends - sizes, sizes, np.zeros(len(again), bool)

    def indices(self, distinct: list[bytes]) -> np.ndarray:
        """Where flat, heads and sizes hold the ids of these pieces; new ones are encoded."""
        if len(self.known) > self.most:
            again = np.flatnonzero(self.met)
            self.forget(again if len(again) <= self.most // 2 else None)
        before = len(self.known)
        new = [x for x in distinct if x not in self.known]
        ids = [e.ids for at in range(0, len(new), 10_000) for e in self.tokenizer.encode_batch_fast([x.decode() for x in new[at : at + 10_000]], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.heads = np.concatenate((self.heads, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))))
        self.met = np.concatenate((self.met, np.zeros(len(new), bool)))
        self.known.update(zip(new, range(before, before + len(new)), strict=True))
        index = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.met[index[index < before]] = True
        return index

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, and which piece each row begins with."""
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        if n > 2:
            plain = ~WHITE[data]
            high = data >= 0x80
            # white space beyond ASCII: U+0085 and U+00A0 begin with C2, the others with E1, E2 or E3
            odd = np.zeros(n + 3, bool)
            odd[1 : n + 1] = data == 0xC2
            wide = (data >= 0xE1) & (data <= 0xE3)
            odd[2 : n + 2] |= wide
            before = plain[:-2] & ~(high[:-2] & odd[: n - 2])
            after = plain[2:] & ~((data[2:] == 0xC2) | wide[2:])
            lone = before & after & ~first[1 : n - 1] & ~first[2:n]
            middle = data[1:-1]
            first[1 : n - 1] |= lone & ((middle == 0x20) | (middle == 0x0A))
            first[2:n] |= lone & (middle == 0x0A)
            kind = KIND[data]
            # U+00C0 to U+017F are letters but for the signs of multiplication (C3 97) and division (C3 B7)
            latin = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))))
            kind[latin] = kind[latin + 1] = 1
            first[1:n] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        starts = np.flatnonzero(first)
        if n not in offsets[-1:]:
            starts = np.append(starts, n)
        return starts, np.searchsorted(starts, offsets)

    def __call__(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after the other, as uint32, and the n + 1 offsets of the rows. end: an id after each row's own."""
        data, offsets = raw(texts)
        starts, rows = self.pieces(data, offsets)
        coded = binary(data, starts).dictionary_encode()
        codes = coded.indices.to_numpy()
        index = self.indices(coded.dictionary.to_pylist())
        sizes, heads = self.sizes[index], self.heads[index]
        each = sizes[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(each)))
        ids = self.flat[np.repeat(heads[codes] - ends[:-1], each) + np.arange(ends[-1])] if len(codes) else self.flat[:0]
        cuts = ends[rows]
        if end is not None:
            ids = np.insert(ids, cuts[1:], np.uint32(end))
            cuts = cuts + np.arange(len(cuts))
        return ids, cuts


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder, kept between tasks."""
    return Encoder(path)


HELD.append(encoder.cache_clear)
