"""Toxicity by noisy-channel deobfuscation: restore disguised words, then score the restored text.

The channel: a writer replaces letters by look-alikes (leetspeak), stretches letters, and puts separators between them.
A word that shows one of these signs becomes a lattice of readings, and Viterbi decoding picks the likeliest under a
character trigram model counted over all documents. Plain words have one reading and pass unchanged.

The score: words and word stems (prefixes) of the restored training texts are counted once for each distinct text, by
64-bit hashes; a term's weight is the lower Wilson bound of the share of toxic texts among those that hold it, and a text's score follows
its heaviest term, bent so that 0.5 lies at the cut that does best on a part of the training rows that the weights were not
learnt from. Labels are read from at most MOST_LABELS distinct labelled texts, taken in order of their hash; all else
covers all documents.

Nulls: a null or empty text has no terms and gets the lowest score; null labels are not learnt from; a null doc_id is
never held out and never learnt from. If labels hold no toxic row, or none at all, every score is below 0.5. Repeated
rows are scored one by one. Columns other than those named are ignored."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Words, distinct, raw, span_hashes, steps, store, table_of, text_or_empty

#: Labelled texts that weights are learnt from at most, lengths of stems, and what tells a stem's hash from a word's.
MOST_LABELS, STEMS, STEM_SEED = 200_000, (4, 5, 6, 7, 8), 0x3C6EF372FE94F82B
#: (term, text) counts that a task holds before it adds them up.
HELD_COUNTS = 1_000_000
#: What each sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = " .-_*~,'"
#: Log-costs of the channel: reading a sign as a letter, dropping a separator or a sign at a word's edge, dropping another sign, dropping a stretched letter.
AS_LETTER, PART, DROP, SQUEEZE = -1.0, -0.5, -14.0, -0.5
#: Characters of the model: 0 between words, 1 to 26 a to z, 27 any other letter.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[0x61:0x7B] = np.arange(1, 27)
SYMBOL[0x80:0xC0] = -1
SYMBOL[0xC0:] = 27
SIZE = 28
#: Bytes of the signs of LEET and of separators that may stand inside a disguised word.
SIGN = table_of([*range(0x30, 0x3A), *(ord(c) for c in LEET if ord(c) < 0x80)])
INSIDE = SIGN | table_of(map(ord, ".-_*~,'"))
#: Single characters in a row that may be a word with its letters set apart: two at least, the model decides the rest.
APART = 2
#: Single bytes that join such a run: letters, digits and every sign of LEET.
JOINS = table_of([*range(0x30, 0x80), *(ord(c) for c in LEET if ord(c) < 0x80)])


def language_model(docs: DataFrame) -> np.ndarray:
    """log p(c | a, b) of characters over all documents, smoothed, as an array of SIZE x SIZE x SIZE."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in steps(batches, "text"):
            data, offsets = raw(pc.utf8_lower(batch.column("text")))
            codes = SYMBOL[np.insert(data, offsets[:-1], 0x20)]
            codes = codes[codes >= 0]
            codes = codes[np.concatenate(([True], (codes[1:] > 0) | (codes[:-1] > 0)))] if len(codes) else codes
            if len(codes) > 2:
                total += np.bincount((codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:], minlength=SIZE**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(seen), "n": pa.array(total[seen])})

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE**3)
    counts[rows["gram"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
    counts = counts.reshape(SIZE, SIZE, SIZE)
    pairs = counts.sum(axis=0)
    once = (pairs + 0.5) / (pairs + 0.5).sum(axis=1, keepdims=True)
    return np.log((counts + 20 * once) / (counts + 20 * once).sum(axis=2, keepdims=True))


def restore(odd: str, model: list[float]) -> str:
    """The likeliest reading of a disguised stretch of lower-case text. model: log p(c | a, b) at (a SIZE + b) SIZE + c."""
    # a path is its last reading and the path before it: steps don't copy what was read
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    inner = [k for k, c in enumerate(odd) if c.isalnum()]
    for at, c in enumerate(odd):
        readings: list[tuple[str, float]] = []
        if c.isalpha() and c not in LEET:
            readings.append((c, 0.0))
            if c == before:
                stretched = odd[max(0, at - 2) : at + 3].count(c) > 2
                readings.append(("", SQUEEZE if stretched else 8 * SQUEEZE))
        else:
            readings += [(x, AS_LETTER) for x in LEET.get(c, "")]
            cheap = c in SEPARATORS or not c.isalnum() and not (inner and inner[0] < at < inner[-1])
            readings += [("", PART if cheap else DROP), (" ", PART if cheap else DROP)]
        ahead: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            base = (a * SIZE + b) * SIZE
            for x, cost in readings:
                if not x or (x == " " and b == 0):
                    state, value, longer = (a, b), score + cost, path
                else:
                    k = 0 if x == " " else ord(x) - 96 if "a" <= x <= "z" else 27
                    state, value, longer = (b, k), score + cost + model[base + k], (path, x)
                if value > ahead.get(state, (-math.inf, None))[0]:
                    ahead[state] = (value, longer)
        best, before = ahead, c
    ends = [(score + model[(a * SIZE + b) * SIZE] * (b > 0), path) for (a, b), (score, path) in best.items()]
    top = max(score for score, _ in ends)
    return max(_spelled(path) for score, path in ends if score == top)


def _spelled(path: tuple | None) -> str:
    out = []
    while path is not None:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of lower-case UTF-8 belong to letters: a to z and all beyond ASCII but Latin-1 signs, general and CJK punctuation, symbols and emoji."""
    out = (data >= 0x80) | ((data >= 0x61) & (data <= 0x7A))
    two = np.flatnonzero((data[:-1] == 0xC2) | (data[:-1] == 0xC3))
    sign = np.where(data[two] == 0xC2, ~np.isin(data[two + 1], (0xAA, 0xB5, 0xBA)), np.isin(data[two + 1], (0x97, 0xB7)))
    for k in (0, 1):
        out[two[sign] + k] = False
    three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] < 0xB0) | (data[:-2] == 0xE3) & (data[1:-1] == 0x80)) if len(data) > 2 else two[:0]
    four = np.flatnonzero((data[:-3] == 0xF0) & (data[1:-2] == 0x9F)) if len(data) > 3 else two[:0]
    for at, size in ((three, 3), (four, 4)):
        for k in range(size):
            out[at + k] = False
    return out


def odd_tokens(data: np.ndarray, cuts: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Which tokens (bytes from cut to cut) show a disguise: letters with a sign or digit among, before or after them, or a letter three times in a row."""
    n = len(data)
    out = np.zeros(len(cuts) - 1, bool)
    if n < 2:
        return out
    of = np.repeat(np.arange(len(cuts) - 1, dtype=np.int32), np.diff(cuts))
    sign, inside = SIGN[data], INSIDE[data]
    euro = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x82) & (data[2:] == 0xAC)) if n > 2 else np.zeros(0, np.int64)
    for k in range(3):
        sign[euro + k] = inside[euro + k] = True
    same = of[1:] == of[:-1]
    out[of[:-1][sign[:-1] & letter[1:] & same]] = True
    after = np.flatnonzero(letter[:-1] & sign[1:] & same)
    behind = after + np.where(data[np.minimum(after + 1, n - 1)] == 0xE2, 4, 2)
    follows = np.minimum(behind, n - 1)
    out[of[after[(behind >= n) | (of[follows] != of[after]) | (data[follows] != 0x21)]]] = True
    # stretches of signs and separators between letters
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    a, b = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)
    full = (a >= 0) & (b < n)
    a, b = a[full], b[full]
    out[of[a[letter[a] & letter[b] & (of[a] == of[b])]]] = True
    for size, low, high in ((1, 0x61, 0x7A), (2, 0xC2, 0xDF), (3, 0xE0, 0xEF)):
        if n >= 3 * size:
            lead = np.flatnonzero(letter[: n - 3 * size + 1] & (data[: n - 3 * size + 1] >= low) & (data[: n - 3 * size + 1] <= high) & (data[: n - 3 * size + 1] == data[size : n - 2 * size + 1]) & (of[: n - 3 * size + 1] == of[3 * size - 1 :]))
            for k in range(2 * size):
                lead = lead[data[lead + k] == data[lead + k + size]]
            out[of[lead]] = True
    return out


def word_terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at starts to ends and of their stems, and which word each is of."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first, last = np.searchsorted(lead, starts), np.searchsorted(lead, ends)
    found, owner = [span_hashes(data, starts, ends)], [np.arange(len(starts))]
    for k in STEMS:
        longer = np.flatnonzero(last - first > k)
        found.append(span_hashes(data, starts[longer], lead[first[longer] + k], STEM_SEED))
        owner.append(longer)
    return np.concatenate(found), np.concatenate(owner)


class Texts:
    """The terms of a batch of texts: hashes of each row's words and stems, those of restored words included.

    Work is done once for each distinct run of characters without white space. token_terms and token_of: the terms of such runs;
    row_terms and row_of: those of letters that white space sets apart, which belong to a row."""

    def __init__(self, texts: pa.Array, reader: Reader):
        words = Words(pc.utf8_lower(texts), SPACED, lower=False)
        self.rows, self.codes, self.reader = words.rows, words.codes, reader
        data, cuts = raw(words.distinct)
        letter = letters(data)
        edge = np.zeros(len(data) + 1, bool)
        edge[cuts] = True
        before = np.concatenate(([False], letter[:-1])) if len(data) else letter
        after = np.concatenate((letter[1:], [False])) if len(data) else letter
        starts, ends = np.flatnonzero(letter & (~before | edge[:-1])), np.flatnonzero(letter & (~after | edge[1:])) + 1
        token = np.searchsorted(cuts, starts, side="right") - 1
        odd = odd_tokens(data, cuts, letter)
        has = np.zeros(len(cuts) - 1, bool)
        has[token] = True
        odd = np.flatnonzero(odd & has)
        view = memoryview(np.ascontiguousarray(data))
        readings = [self.reader.restored(bytes(view[a:b])) for a, b in zip(cuts[odd].tolist(), cuts[odd + 1].tolist(), strict=True)]
        terms, of = word_terms(data, starts, ends)
        more, word = self._spelt([w for r in readings for w in r])
        self.token_terms = np.concatenate((terms, more))
        self.token_of = np.concatenate((token[of], np.repeat(odd, [len(r) for r in readings])[word]))
        self.plain = (data, starts, ends, token)
        self.readings = dict(zip(odd.tolist(), readings, strict=True))
        # letters set apart by white space: runs of words of one character
        size = words.ends - words.starts
        lead = words.data[words.starts] if len(size) else np.zeros(0, np.uint8)
        single = (size == 1) & JOINS[lead] | (size == 2) & (lead >= 0xC0)
        one = lambda k: bytes(view[cuts[k] : cuts[k + 1]])
        for k in np.flatnonzero((size == 3) & (lead == 0xE2)).tolist():
            single[k] = one(self.codes[k]).decode(errors="replace") in LEET
        single = np.concatenate(([False], single, [False])).astype(np.int8)
        step = np.diff(single)
        apart: list[tuple[int, list[str]]] = []
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            if b - a < APART:
                continue
            row = int(np.searchsorted(self.rows, a, side="right")) - 1
            while a < b:  # a run ends with its row
                end = min(b, int(self.rows[row + 1]))
                if end - a >= APART:
                    apart.append((row, self.reader.restored(b" ".join(map(one, self.codes[a:end].tolist())))))
                a = end
                while a < b and a >= self.rows[row + 1]:
                    row += 1
        self.row_terms, word = self._spelt([w for _, r in apart for w in r])
        self.row_of = np.repeat(np.array([row for row, _ in apart], np.int64), [len(r) for _, r in apart])[word]
        self.apart = apart

    @staticmethod
    def _spelt(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in coded], dtype=np.int64)
        data = np.frombuffer(b"".join(coded), np.uint8)
        return word_terms(data, np.concatenate((np.zeros(min(1, len(ends)), np.int64), ends[:-1])), ends)

    def terms(self) -> Iterator[set[str]]:
        """Each row's words, plain and restored, in letters."""
        data, starts, ends, token = self.plain
        at = np.searchsorted(token, np.arange(len(self.codes) and int(self.codes.max()) + 2))
        for k in range(len(self.rows) - 1):
            codes = distinct(self.codes[self.rows[k] : self.rows[k + 1]]).tolist()
            words = {bytes(data[starts[i] : ends[i]]).decode(errors="replace") for c in codes for i in range(at[c], at[c + 1])}
            yield words.union(*(self.readings.get(c, ()) for c in codes), *(r for row, r in self.apart if row == k))

    def heaviest(self) -> np.ndarray:
        """Each row's largest weight."""
        least = self.reader.weights.least
        each = np.full(int(self.token_of.max()) + 1 if len(self.token_of) else 0, least)
        np.maximum.at(each, *self.reader.weights.known(self.token_terms, self.token_of))
        out = np.full(len(self.rows) - 1, least)
        if len(self.codes):
            each = np.concatenate((each, np.full(int(self.codes.max()) + 1 - len(each), least))) if self.codes.max() >= len(each) else each
            full = np.flatnonzero(np.diff(self.rows))
            out[full] = np.maximum.reduceat(each[self.codes], self.rows[full])
        np.maximum.at(out, *self.reader.weights.known(self.row_terms, self.row_of))
        return out

    def counted(self, toxic: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, ...]:
        """term, part, n texts, t toxic texts over the rows, each text counted once for a term."""
        row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))
        many = int(self.codes.max()) + 1 if len(self.codes) else 1
        row, code = np.divmod(distinct(row * many + self.codes), many)
        order = np.argsort(self.token_of, kind="stable")
        heads = np.searchsorted(self.token_of[order], np.arange(many + 1))
        size = (heads[1:] - heads[:-1])[code]
        ends = np.cumsum(size)
        each = order[np.repeat(heads[code] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        terms, at = np.unique(np.concatenate((self.token_terms, self.row_terms)), return_inverse=True)
        rows = len(self.rows) - 1
        pair = distinct(np.concatenate((at[each] * rows + np.repeat(row, size), at[len(self.token_terms) :] * rows + self.row_of)))
        term, row = np.divmod(pair, max(1, rows))
        n = np.bincount(term * 2 + part[row], minlength=2 * len(terms))
        t = np.bincount(term * 2 + part[row], weights=toxic[row], minlength=2 * len(terms)).astype(np.int64)
        full = np.flatnonzero(n)
        return terms[full // 2], full % 2, n[full], t[full]


class Weights:
    """Weights of terms, by hash, and the weight of all others."""

    BITS = 20

    def __init__(self, terms: np.ndarray, values: np.ndarray, least: float):
        order = np.argsort(terms)
        self.terms, self.values, self.least = terms[order], values[order], least
        self.hit = np.zeros(1 << self.BITS, bool)
        self.hit[self.terms >> np.uint64(64 - self.BITS)] = True

    def known(self, terms: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owner and weight of the terms that have one."""
        some = np.flatnonzero(self.hit[terms >> np.uint64(64 - self.BITS)])
        at = np.searchsorted(self.terms, terms[some])
        right = self.terms[np.minimum(at, len(self.terms) - 1)] == terms[some] if len(self.terms) else np.zeros(0, bool)
        return owner[some[right]], self.values[at[right]]


NOTHING = Weights(np.zeros(0, np.uint64), np.zeros(0), 0.0)


class Reader:
    """Restores disguised runs of characters; weights: of terms."""

    def __init__(self, model: np.ndarray, weights: Weights = NOTHING):
        self.model, self.weights = np.asarray(model).ravel().tolist(), weights
        self.short: dict[bytes, list[str]] = {}

    def restored(self, odd: bytes) -> list[str]:
        if len(odd) > 32:
            return restore(odd.decode(errors="replace"), self.model).split()
        if (words := self.short.get(odd)) is None:
            if len(self.short) >= 20_000:
                self.short.clear()
            words = self.short[odd] = restore(odd.decode(errors="replace"), self.model).split()
        return words


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def training(docs: DataFrame, labels: DataFrame, most: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (toxic, fold) of the rows to learn from: one for each distinct text, none that is held out."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    texts = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("digest"))
    one = texts.join(marks, "doc_id").groupBy("digest").agg(F.min(F.struct("doc_id", "toxic")).alias("row"))
    rows = one.orderBy("digest").limit(most).select("row.*").toPandas()
    return {int(i): (int(bool(t)), fold(int(i))) for i, t in zip(rows["doc_id"], rows["toxic"], strict=True)}


def _added(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """Counts of the same term and part become one."""
    if not parts:
        return []
    term, part, n, t = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((part, term))
    term, part, n, t = term[order], part[order], n[order], t[order]
    heads = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (part[1:] != part[:-1]))))
    return [(term[heads], part[heads], np.add.reduceat(n, heads), np.add.reduceat(t, heads))]


def term_counts(docs: DataFrame, learn, model) -> DataFrame:
    """term (its hash), part (0: weights, 1: cut), n texts, t toxic texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, reader, held = learn.value, Reader(model.value), []

        def flush() -> Iterator[pa.RecordBatch]:
            for term, part, n, t in _added(held):
                yield pa.RecordBatch.from_pydict({"term": pa.array(term.view(np.int64)), "part": pa.array(part.astype(np.int32)), "n": pa.array(n.astype(np.int64)), "t": pa.array(t)})
            held.clear()

        for batch in steps(batches, "text"):
            at = [(k, *known[d]) for k, d in enumerate(batch.column("doc_id").to_pylist()) if d in known]
            if not at:
                continue
            row, toxic, part = np.array(at, np.int64).T
            texts = Texts(batch.column("text").take(pa.array(row)), reader)
            got = texts.counted(toxic, (part == 1).astype(np.int64))
            if len(got[0]):
                held.append(got)
            if sum(len(x[0]) for x in held) > HELD_COUNTS:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(count, "term long, part int, n long, t long").groupBy("term", "part").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def weights(counts: DataFrame, least: float) -> Weights:
    """Terms whose bound is above least, with the bound; any other weighs half of least. counts: term, n, t. They are gathered on the driver (16
    bytes each): terms of two toxic texts at least, out of at most most_labels texts."""
    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    z = 1.96
    bound = (t / n + z * z / (2 * n) - z * F.sqrt(t / n * (1 - t / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    rows = counts.where("t > 1").select("term", bound.alias("bound")).where(F.col("bound") > least).toPandas()
    return Weights(rows["term"].to_numpy(dtype=np.int64).view(np.uint64), rows["bound"].to_numpy(dtype=float), least / 2)


def _scored(docs: DataFrame, model, terms, learn=None) -> DataFrame:
    """doc_id and heaviest weight; learn: only rows of the part that finds the cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value, terms.value)
        for batch in steps(batches, "text"):
            if learn is not None:
                known = learn.value
                batch = batch.take(pa.array([k for k, d in enumerate(batch.column("doc_id").to_pylist()) if d in known and known[d][1] == 1], pa.int64()))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(Texts(batch.column("text"), reader).heaviest())], names=["doc_id", "weight"])

    return docs.mapInArrow(run, "doc_id long, weight double")


def _cut(weight: np.ndarray, toxic: np.ndarray) -> float:
    """Where accuracy is best on these rows; the middle of the best gap."""
    if not len(weight) or not toxic.any():
        return 0.6
    order = np.argsort(weight, kind="stable")
    w, y = weight[order], toxic[order]
    right = np.concatenate(([y.sum()], y.sum() + np.cumsum(1 - 2 * y)))  # with the first k below the cut
    allowed = np.concatenate(([True], w[1:] > w[:-1], [True]))
    best = np.flatnonzero(allowed & (right == right[allowed].max()))
    edge = np.concatenate(([0.0], w, [1.0]))
    k = best[np.argmax(edge[best + 1] - edge[best])]
    return float(min(0.99, max(0.3, (edge[k] + edge[k + 1]) / 2)))


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS):
    """The shared character model and weights, and the cut."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    share = docs.sparkSession.sparkContext.broadcast
    learned = training(rows, labels, most_labels)
    least = max(0.05, sum(t for t, _ in learned.values()) / max(1, len(learned)))
    learn, model = share(learned), share(language_model(rows))
    counts = store(term_counts(rows, learn, model), "terms")
    first = weights(counts.where("part = 0"), least)
    final = weights(counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), least)
    tried = _scored(rows, model, share(first), learn).toPandas()
    cut = _cut(tried["weight"].to_numpy(dtype=float), np.array([learned[int(i)][0] for i in tried["doc_id"]], np.int64))
    learn.unpersist()
    return model, share(final), cut


def score(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model, terms, cut = fit(docs, labels, most_labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    w = F.col("weight")
    bent = F.when(w >= cut, 0.5 + 0.5 * (w - cut) / (1 - cut)).otherwise(F.least(0.5 * w / cut, F.lit(0.4999)))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = _scored(rows, model, terms).select("doc_id", held_out.alias("held_out"), bent.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted to be toxic."""
    model, terms, cut = fit(docs, labels, most_labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value, terms.value)
        for batch in steps(batches, "text"):
            texts = batch.column("text")
            texts = texts.fill_null("") if texts.null_count else texts
            yield batch.filter(pa.array(Texts(texts, reader).heaviest() < cut))

    return docs.mapInArrow(run, docs.schema)
