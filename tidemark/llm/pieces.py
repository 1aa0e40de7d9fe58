"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. When no edge goes on from a node, greedy longest-match has settled the first pieces of the
node's string: the failure link leads to the node of what is left, and the number of settled pieces is known beforehand.
So a word's pieces are counted in one pass, without building them. All words of a batch step through the automaton together.

A word is a run of characters without white space, with a blank before it, as bytes; every byte is a piece of the
vocabulary, so no word is unknown. Nulls: a null or empty text has no words and no pieces; a null doc_id is kept. Repeated
rows are counted one by one. An empty table gives no rows. Other columns are ignored."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Words, raw, steps, text_or_empty
from .tokens import vocabulary


def byte_signs() -> dict[str, int]:
    """The sign that the public byte-level vocabulary writes for each byte: printable ones stand for themselves, others for U+0100 and up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Automaton:
    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                if (after := children[node].get(byte)) is None:
                    after = children[node][byte] = len(children)
                    children.append({})
                    ends.append(False)
                node = after
            ends[node] = True
        fail, pops = [-1] * len(children), [0] * len(children)
        level = [0]
        while level:
            below = []
            for u in level:
                for byte, v in children[u].items():
                    below.append(v)
                    if ends[v]:
                        fail[v], pops[v] = 0, 1
                        continue
                    z, n = fail[u], pops[u]
                    while z >= 0 and byte not in children[z]:
                        n += pops[z]
                        z = fail[z]
                    fail[v], pops[v] = (children[z][byte], n) if z >= 0 else (-1, n)
            level = below
        edges = sorted((u << 8 | b, v) for u, c in enumerate(children) for b, v in c.items())
        self.keys, self.to = np.array([k for k, _ in edges], np.int64), np.array([v for _, v in edges], np.int64)
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)

    def counts(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Pieces of each word, given its bytes' place and number."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for at in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -at, side="left"))
            byte = data[starts[:live] + at].astype(np.int64)
            todo = np.arange(live)
            while len(todo):
                key = state[todo] << 8 | byte[todo]
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[found] == key
                state[todo[hit]] = self.to[found[hit]]
                todo = todo[~hit]
                count[todo] += self.pops[state[todo]]
                state[todo] = self.fail[state[todo]]
                if (state[todo] < 0).any():
                    raise ValueError("a byte is missing from the vocabulary")
        while (left := np.flatnonzero(state > 0)).size:
            count[left] += self.pops[state[left]]
            state[left] = self.fail[state[left]]
        out = np.empty_like(count)
        out[order] = count
        return out


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    signs = byte_signs()
    with open(path, encoding="utf-8") as file:
        words = json.load(file)["model"]["vocab"]
    return Automaton([bytes(signs[c] for c in w) for w in words if all(c in signs for c in w)])


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_pieces, most_pieces (of one word)."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in steps(batches, "text"):
            words = Words(batch.column("text"), SPACED, lower=False)
            data, cuts = raw(words.distinct)
            data = np.insert(data, cuts[:-1], 0x20)
            starts = cuts[:-1] + np.arange(len(cuts) - 1)
            each = machine.counts(data, starts, np.diff(cuts) + 1)[words.codes]
            n = np.diff(words.rows)
            total = np.diff(np.concatenate(([0], np.cumsum(each)))[words.rows])
            most, full = np.zeros(len(n), np.int64), np.flatnonzero(n)
            if len(full):
                most[full] = np.maximum.reduceat(each, words.rows[full])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(total), pa.array(most)], names=["doc_id", "n_words", "n_pieces", "most_pieces"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_pieces long, most_pieces long")
