"""Benchmark decontamination with SimHash windows and a multi-index of Hamming blocks.

A benchmark item is a word sequence (lower-cased runs of letters and digits),
and its set is its distinct five-word shingles, weighted by how often they
occur.  A document is contaminated by an item if a window of as many words as
the item has a weighted Jaccard similarity of at least 0.8 with it.

1. Items are few; their shingles, fingerprints and Hamming-block index are
   built once and shared with the executors.  Their size is checked: beyond
   ``MAX_ITEM_WORDS`` in all they are taken in groups, one pass for each.
2. Every window of an item's size that holds one of the item's shingles gets a
   64-bit SimHash of its words, from running sums of its bits; other windows
   share nothing with an item and cannot be similar.
3. The index has the items' fingerprints by 11 blocks of bits; a fingerprint
   within radius 10 agrees with the item's in one block at least, so the look-up
   returns all of them.  Similar windows may be farther apart than any radius
   that an index can serve (a changed end of 6 in 59 words is 9 bits on
   average), so an item that no window brings up is also taken if the document
   has as many of its shingles as a similar window needs; the tests measure how
   much the index finds alone.
4. The exact weighted-shingle similarity decides, over all windows of the
   document: it changes only where a shared shingle comes in or goes out.

Items with fewer words than five are one shingle of their own length and match
where their words stand consecutively.

Defined cases: null or empty documents are clean; items without words match
nothing; repeated items and documents are answered each on their own; ties for
a document's best window go to the earliest; very long documents are taken
whole, their windows in runs; empty tables give no rows or lose none; extra
columns stay in ``clean`` and are ignored otherwise.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm import storage, textkit

K = 5
RADIUS = 10
#: Words of items that one pass shares with the executors (some 100 MB of index).
MAX_ITEM_WORDS = 1_000_000
#: Windows that are fingerprinted together.
RUN = 4096
_U = np.uint64
_BLOCKS = RADIUS + 1
_EDGES = [64 * k // _BLOCKS for k in range(_BLOCKS + 1)]


def simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash of word hashes, each occurrence with weight one."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def window_prints(hashes: np.ndarray, first: int, last: int, size: int) -> list[int]:
    """SimHashes of the windows of so many words that start at first to last."""
    out = []
    for a in range(first, last + 1, RUN):
        part = hashes[a : min(a + RUN, last + 1) - 1 + size]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, 0, dtype=np.int32)])
        width = min(size, len(part))
        out += np.packbits(2 * (sums[width:] - sums[:-width]) > width, axis=1, bitorder="little").view("<u8")[:, 0].tolist()
    return out


def blocks(fingerprint: int) -> Iterator[tuple[int, int]]:
    for k in range(_BLOCKS):
        yield k, fingerprint >> _EDGES[k] & (1 << _EDGES[k + 1] - _EDGES[k]) - 1


def shingle_counts(hashes: np.ndarray) -> Counter:
    """A window's weighted shingles; a short sequence is one."""
    n = min(K, len(hashes))
    return Counter(textkit.windows(hashes, n).tolist()) if n else Counter()


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(v, b[k]) for k, v in a.items() if k in b)
    return both / (a.total() + b.total() - both) if both else 0.0


class Index:
    """The items of one pass."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids, self.sizes, self.counts, self.prints = [], [], [], []
        self.by_block: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        places: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            data, offsets = textkit.utf8(pa.array([text], pa.string()))
            hashes = textkit.words(data, offsets, textkit.ALNUM)[2]
            if not len(hashes):
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.sizes.append(len(hashes))
            self.counts.append(shingle_counts(hashes))
            self.prints.append(simhash(hashes))
            for b, value in blocks(self.prints[-1]):
                self.by_block[len(hashes), b, value].append(k)
            n = min(K, len(hashes))
            for at, s in enumerate(textkit.windows(hashes, n).tolist()):
                places[n][s].append((k, at))
        self.by_block = dict(self.by_block)
        self.places = {n: dict(p) for n, p in places.items()}
        self.known = {n: np.sort(np.array(list(p), _U)) for n, p in self.places.items()}
        #: One bit for the low 20 bits of every known shingle, to turn most of a text's away cheaply.
        self.sieve = {}
        for n, known in self.known.items():
            self.sieve[n] = np.zeros(1 << 20, bool)
            self.sieve[n][(known & _U((1 << 20) - 1)).astype(np.int64)] = True

    def near(self, fingerprint: int, size: int) -> set[int]:
        """All items of so many words whose fingerprints are within the radius."""
        found = {k for b, value in blocks(fingerprint) for k in self.by_block.get((size, b, value), ())}
        return {k for k in found if (self.prints[k] ^ fingerprint).bit_count() <= RADIUS}

    def near_windows(self, hashes: np.ndarray, places: dict[int, set[int]]) -> set[int]:
        """Items within the radius of a window that holds a known shingle; places: by window size, where those start."""
        near, words = set(), len(hashes)
        for size, starts in places.items():
            n, last, reach = min(K, size), max(words - size, 0), -1
            for q in sorted(starts):
                a, b = max(q - size + n, reach + 1, 0), min(q, last)
                if a <= b:
                    for fingerprint in set(window_prints(hashes, a, b, size)):
                        near |= self.near(fingerprint, size)
                    reach = b
                elif q > last and reach < last:
                    near |= self.near(window_prints(hashes, last, last, size)[0], size)
                    reach = last
        return near

    def hits(self, rolled: np.ndarray, n: int) -> np.ndarray:
        """Where a known shingle of n words starts."""
        at = np.flatnonzero(self.sieve[n][(rolled & _U((1 << 20) - 1)).astype(np.int64)])
        known = self.known[n]
        place = np.minimum(np.searchsorted(known, rolled[at]), len(known) - 1)
        return at[known[place] == rolled[at]]

    def best(self, k: int, shared: list[tuple[int, int]], words: int) -> tuple[float, int]:
        """Similarity and start of an item's best window, of all that a text of so many words has; shared: place and shingle, by place."""
        own, n = self.counts[k], min(K, self.sizes[k])
        width = min(self.sizes[k], words) - n + 1  # shingles of a window
        have, both, most, start, tail = Counter(), 0, 0, 0, 0
        for q, s in shared:
            first = max(q - width + 1, 0)
            while shared[tail][0] < first:
                gone = shared[tail][1]
                both -= have[gone] <= own[gone]
                have[gone] -= 1
                tail += 1
            have[s] += 1
            both += have[s] <= own[s]
            if both > most:
                most, start = both, first
        return most / (own.total() + width - most), start

    def match(self, hashes: np.ndarray, hits: dict[int, np.ndarray]) -> list[tuple[int, int, int, float]]:
        """(item, start, words, similarity) of the best window of every item that a text contains."""
        places, shared = defaultdict(set), defaultdict(list)
        for n, at in hits.items():
            for q, s in zip(at.tolist(), textkit.windows(hashes, n)[at].tolist(), strict=True):
                for k, _ in self.places[n][s]:
                    places[self.sizes[k]].add(q)
                    if not shared[k] or shared[k][-1][0] != q:
                        shared[k].append((q, s))
        near = self.near_windows(hashes, places)
        # A window that is similar has 8/18 of the shingles of both; the radius may turn it away all the same.
        near |= {k for k, x in shared.items() if 18 * len(x) >= 8 * (self.counts[k].total() + min(self.sizes[k], len(hashes)) - min(K, self.sizes[k]) + 1)}
        best = [(k, *self.best(k, shared.get(k, []), len(hashes))) for k in sorted(near)]
        return [(self.ids[k], start, self.sizes[k], similarity) for k, similarity, start in best if 10 * similarity >= 8 - 1e-9]


def _found(index: Index, column: pa.Array) -> tuple[list[int], list[tuple[int, int, int, float]]]:
    """Rows of a column and the matches they have."""
    rows, found = [], []
    for a, _, _, _, _, _, hashes, at, _ in textkit.texts_in_runs(column, textkit.ALNUM):
        cuts: dict[int, dict[int, np.ndarray]] = {}
        for n in index.places:
            hit = index.hits(textkit.windows(hashes, n), n)
            row = np.searchsorted(at, hit, "right") - 1
            keep = hit + n <= at[row + 1]
            hit, row = hit[keep], row[keep]
            for r in np.unique(row).tolist():
                cuts.setdefault(r, {})[n] = hit[row == r] - at[r]
        for r in sorted(cuts):
            got = index.match(hashes[at[r] : at[r + 1]], cuts[r])
            rows += [a + r] * len(got)
            found += got
    return rows, found


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = _found(shared.value, batch.column(1))
            item, start, size, similarity = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(similarity, pa.float64())], ["doc_id", "item_id", "start_word", "n_words", "similarity"])
        batch = None
        textkit.release()

    return run


def _drop(shared, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.parts(batch, text):
                gone = set(_found(shared.value, part.column(text))[0])
                yield part.take(pa.array([k for k in range(part.num_rows) if k not in gone], pa.int64()))
        batch = part = None
        textkit.release()

    return run


def _passes(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in groups that fit one pass; the driver holds one group at a time."""
    part, held = [], 0
    for row in items.select(F.col(item).cast("bigint"), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        part.append((row[0], row[1]))
        held += len(row[1]) // 2 + 1
        if held >= MAX_ITEM_WORDS:
            yield part
            part, held = [], 0
    if part:
        yield part


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: each document's best window for each item that it contains."""
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, item_id bigint, start_word bigint, n_words bigint, similarity double"
    out = None
    for part in _passes(items, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Index(part))
        found = docs.select(F.col(key), F.col(text)).mapInArrow(_search(shared), schema)
        out = found if out is None else out.union(found)
    return storage.no_rows(docs.sparkSession, schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    for part in _passes(items, item, item_text):
        docs = docs.mapInArrow(_drop(docs.sparkSession.sparkContext.broadcast(Index(part)), docs.columns.index(text)), docs.schema)
    return docs
