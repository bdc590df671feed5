"""Benchmark decontamination: windows of an item's size, exact similarity of weighted shingles.

Words are runs of letters and digits in lower case; shingles are five words (an item of fewer words is one shingle of all
of them; an item without words matches nothing). For each item, windows of the item's own number of shingles slide over a
document by one word. A window counts if the weighted Jaccard similarity of the two bags of shingles, shingles weighing more
the fewer items of the whole benchmark have them, is at least 0.8. A document shorter than an item is one window.

Candidates come from SimHashes of windows and items, 64 bits in which every shingle votes with the weight it has in the exact
check. Only windows that hold enough of an item's weight are fingerprinted: running sums bound each window's similarity from
above, so none that could reach the threshold is left out. A multi-index then finds the items within `RADIUS` bits of a
window: fingerprints are cut into five blocks; two within 19 bits of each other are within 3 bits in some block, and the
index lists every item under all block values within 3 bits of its own, so no fingerprint within the radius is missed.
Candidates are compared exactly, from the greatest bound down, as long as a bound reaches the best similarity so far.

A window of similarity 0.8 can lie further apart than the radius; README has the share found, measured against all windows.
With `radius=None` no window is passed over: all that the bounds allow are compared.

Items are processed in blocks of `BLOCK` items and bounded size, each an index that goes to all tasks; all documents are
read for each block. Weights are those of the whole benchmark, whatever the blocks: with several blocks, items per shingle
are counted by Spark, and each index has the counts of all shingles that more than one item has. Documents are not shuffled.

Null texts are empty. Null ids come back as they are, repeated rows once each. Without items or documents the result is
empty. Texts are scanned whole, whatever their length.
"""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from kilowatch.llm.common import NOT_WORD, SHINGLE_WORDS, SIMILARITY, emit, shingle_hashes, texts, word_hashes

RADIUS = 19  # bits
CUTS = (0, 13, 26, 39, 52, 64)  # of a fingerprint into blocks
UNITS = 1024  # weights vote as whole numbers, so that equal windows have equal fingerprints
BLOCK = 2000
BLOCK_BYTES = 32 << 20
_STRETCH = 4096
_SLACK = 1e-6  # far above what sums of doubles lose


def words_of(text):
    return word_hashes(text.lower().encode(), NOT_WORD)


# ---- index of a block of items --------------------------------------------------------------------------------------


def _flips(width, bits):
    """All flips of at most `bits` bits of a block."""
    return np.array([sum(1 << b for b in flips) for n in range(bits + 1) for flips in itertools.combinations(range(width), n)], np.int64)


def _block(prints, k):
    return ((prints >> np.uint64(CUTS[k])) & np.uint64((1 << (CUTS[k + 1] - CUTS[k])) - 1)).astype(np.int64)


class Items:
    """Items of one shingle size: their bags, weights and fingerprints, and the multi-index of a radius.

    `counts` has the number of items of this size in the whole benchmark, the shingles that several of them have, and how
    many have each; without it, the rows are the whole benchmark.
    """

    def __init__(self, size, rows, radius, threshold, counts=None):
        self.size, self.radius, self.threshold = size, radius, threshold
        self.ids = [i for i, _ in rows]
        hashes = [shingle_hashes(w, size) for _, w in rows]
        self.lengths = np.array([len(h) for h in hashes])
        self.bags = [Counter(h.tolist()) for h in hashes]
        having = Counter(itertools.chain.from_iterable(self.bags))
        total, shared = (len(rows), {h: n for h, n in having.items() if n > 1}) if counts is None else (counts[0], dict(zip(counts[1].tolist(), counts[2].tolist())))
        self.rare = 1 + math.log(total)
        self.weights = dict.fromkeys(having, self.rare) | {h: 1 + math.log(total / n) for h, n in shared.items()}
        self.shared = np.array(sorted(shared), np.uint64)
        self.shared_weights = np.array([self.weights[h] for h in self.shared.tolist()])
        self.prints = np.array([self._prints(h, np.array([0]), np.array([len(h)]))[0] for h in hashes], np.uint64)
        self.shingles = np.array(sorted(having), np.uint64)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.shingles & np.uint64(0xFFFF)).astype(np.int64)] = True
        place = np.searchsorted(self.shingles, np.array([h for bag in self.bags for h in bag], np.uint64))
        times = np.array([n for bag in self.bags for n in bag.values()], np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(bag) for bag in self.bags])
        order = np.argsort(place, kind="stable")
        self.owners, self.times = owner[order], times[order]
        self.begins = np.searchsorted(place[order], np.arange(len(self.shingles) + 1))
        self.own = np.split(place, np.cumsum([len(bag) for bag in self.bags])[:-1])
        self.shingle_weights = np.array([self.weights[h] for h in self.shingles.tolist()])
        self.masses = np.bincount(owner, self.shingle_weights[place] * times, len(rows))
        self.tables = None

    def __getstate__(self):
        """Tasks build the multi-index for themselves, if they need it."""
        return self.__dict__ | {"tables": None}

    def _table(self, k):
        """Block value to items: where a value's items begin, and the items."""
        width = CUTS[k + 1] - CUTS[k]
        near = _flips(width, self.radius // (len(CUTS) - 1))
        values = (_block(self.prints, k)[:, None] ^ near[None, :]).ravel()
        items = np.repeat(np.arange(len(self.prints), dtype=np.int32), len(near))
        order = np.argsort(values, kind="stable")
        return np.searchsorted(values[order], np.arange((1 << width) + 1)), items[order]

    def hits(self, hashes):
        """Places of shingles that some item has, and their places in `shingles`."""
        maybe = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.shingles, hashes[maybe]), len(self.shingles) - 1)
        real = self.shingles[place] == hashes[maybe]
        return maybe[real], place[real]

    def candidates(self, prints):
        """(window, item) of all pairs of fingerprints within the radius, by the multi-index."""
        pairs = []
        if self.tables is None:
            self.tables = [self._table(k) for k in range(len(CUTS) - 1)]
        for k, (begins, items) in enumerate(self.tables):
            value = _block(prints, k)
            counts = begins[value + 1] - begins[value]
            window = np.repeat(np.arange(len(prints)), counts)
            within = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts)
            item = items[np.repeat(begins[value], counts) + within]
            near = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            pairs.append(window[near] * len(self.ids) + item[near])
        found = np.unique(np.concatenate(pairs))
        return found // len(self.ids), found % len(self.ids)

    def similarity(self, item, window):
        """Weighted Jaccard similarity of an item's bag and a window's shingles."""
        own, other = self.bags[item], Counter(window)
        both = sum(self.weights[h] * min(n, other[h]) for h, n in own.items() if h in other)
        either = sum(self.weights[h] * n for h, n in own.items()) + sum(self.weights.get(h, self.rare) * n for h, n in other.items()) - both
        return both / either

    def _within_reach(self, which):
        """Items of which the shingles in a document, each at most as often as the item has it, weigh enough."""
        found, often = np.unique(which, return_counts=True)
        counts = self.begins[found + 1] - self.begins[found]
        entry = np.repeat(self.begins[found] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        weight = np.repeat(self.shingle_weights[found], counts) * np.minimum(np.repeat(often, counts), self.times[entry])
        return np.flatnonzero(np.bincount(self.owners[entry], weight, len(self.ids)) >= self.threshold * self.masses * (1 - _SLACK))

    def _weights_of(self, hashes):
        weights = np.full(len(hashes), self.rare)
        if len(self.shared):
            place = np.minimum(np.searchsorted(self.shared, hashes), len(self.shared) - 1)
            known = self.shared[place] == hashes
            weights[known] = self.shared_weights[place[known]]
        return weights

    def _document_weights(self, hashes):
        """Running sum of the weights of a document's shingles."""
        return np.concatenate(([0.0], np.cumsum(self._weights_of(hashes))))

    def _prints(self, hashes, starts, ends):
        """SimHash of windows in ascending order, from running sums of the weighted bits; stretches without a window are
        skipped."""
        groups = np.concatenate(([0], np.flatnonzero(starts[1:] > np.maximum.accumulate(ends)[:-1]) + 1, [len(starts)]))
        out = np.zeros(len(starts), np.uint64)
        for a, b in zip(groups[:-1].tolist(), groups[1:].tolist()):
            base, stop = int(starts[a]), int(ends[a:b].max())
            units = np.rint(self._weights_of(hashes[base:stop]) * UNITS).astype(np.int64)
            block = np.ascontiguousarray(hashes[base:stop], "<u8").view(np.uint8).reshape(-1, 8)
            sums = np.zeros((stop - base + 1, 65), np.int64)
            np.cumsum(np.unpackbits(block, axis=1, bitorder="little") * units[:, None], axis=0, out=sums[1:, :64])
            np.cumsum(units, out=sums[1:, 64])
            votes = sums[ends[a:b] - base] - sums[starts[a:b] - base]
            out[a:b] = np.packbits(2 * votes[:, :64] > votes[:, 64:], axis=1, bitorder="little").view("<u8")[:, 0]
        return out

    def matches(self, words):
        """item -> (similarity, -start, words, bits): the best window of each item found in a document."""
        best = {}
        if len(words) < self.size:
            return best
        hashes = shingle_hashes(words, self.size)
        at, which = self.hits(hashes)
        if not len(at):
            return best
        reach = self._within_reach(which)
        if not len(reach):
            return best
        sums, lengths = self._document_weights(hashes), self.lengths[reach]
        for length in np.unique(lengths).tolist():
            near = {}
            for item in reach[lengths == length].tolist():
                mine = np.isin(which, self.own[item])
                near[item] = self._bounded(hashes, sums, item, at[mine], self.shingle_weights[which[mine]])
            if self.radius is not None:
                near = self._within_radius(hashes, length, near)
            for item, (starts, bounds) in near.items():
                self._compare(hashes, item, starts, bounds, best)
        return best

    def _bounded(self, hashes, sums, item, places, weights):
        """Starts of the item's windows whose similarity can reach the threshold, ascending, and their bounds; `places` are
        those of the item's shingles."""
        length = int(self.lengths[item])
        count = max(1, len(hashes) - length + 1)
        change = np.zeros(count + 1, np.int64)
        np.add.at(change, np.maximum(0, places - length + 1), 1)
        np.add.at(change, np.minimum(count, places + 1), -1)
        starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        ends = np.minimum(starts + length, len(hashes))
        running = np.concatenate(([0.0], np.cumsum(weights)))
        both = np.minimum(running[np.searchsorted(places, ends)] - running[np.searchsorted(places, starts)], self.masses[item])
        bounds = both / np.maximum(both, self.masses[item] + sums[ends] - sums[starts] - both) + _SLACK
        near = bounds >= self.threshold
        return starts[near], bounds[near]

    def _within_radius(self, hashes, length, near):
        """Of each item's windows those whose fingerprint the multi-index finds with it; items are of one length."""
        windows, found = np.unique(np.concatenate([starts for starts, _ in near.values()])), []
        for k in range(0, len(windows), _STRETCH):
            some = windows[k : k + _STRETCH]
            window, item = self.candidates(self._prints(hashes, some, np.minimum(some + length, len(hashes))))
            found.append(np.stack([some[window], item]))
        window, item = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        kept = {}
        for one, (starts, bounds) in near.items():
            some = np.isin(starts, window[item == one])
            kept[one] = starts[some], bounds[some]
        return kept

    def _compare(self, hashes, item, starts, bounds, best):
        """The best of the item's candidates."""
        top, length = None, int(self.lengths[item])
        for w in np.argsort(-bounds, kind="stable").tolist():
            if top and bounds[w] < top[0]:
                break
            start, end = int(starts[w]), min(int(starts[w]) + length, len(hashes))
            similarity = self.similarity(item, hashes[start:end].tolist())
            if similarity >= self.threshold and (top is None or (similarity, -start) > top[:2]):
                top = similarity, -start, end - start + self.size - 1
        if top:
            start, end = -top[1], -top[1] + top[2] - self.size + 1
            seen = self._prints(hashes, np.array([start]), np.array([end]))[0]
            best[item] = (*top, (int(seen) ^ int(self.prints[item])).bit_count())


class Index:
    """A block of items, by shingle size."""

    def __init__(self, rows, radius=None, threshold=SIMILARITY, counts=None):
        by = defaultdict(list)
        for item_id, text in rows:
            words = words_of(text or "")
            if len(words):
                by[min(SHINGLE_WORDS, len(words))].append((item_id, words))
        self.groups = [Items(size, group, radius, threshold, counts and counts[size]) for size, group in sorted(by.items())]

    def __call__(self, text):
        """(item_id, similarity, start_word, n_words, bits) of the items found in a text, the best window of each."""
        words = words_of(text)
        return [
            (group.ids[item], similarity, -start, n, bits)
            for group in self.groups
            for item, (similarity, start, n, bits) in sorted(group.matches(words).items())
        ]


# ---- tables ---------------------------------------------------------------------------------------------------------


def _counts(items):
    """By shingle size: number of items, shingles that several of them have, and how many have each."""

    def run(batches):
        schema = pa.schema([("size", pa.int32()), ("shingle", pa.int64())])
        for batch in batches:
            for text in batch["text"].to_pylist():
                words = words_of(text)
                if len(words):
                    size = min(SHINGLE_WORDS, len(words))
                    found = np.unique(shingle_hashes(words, size)).view(np.int64)
                    places = pa.array(np.append(found, 0), mask=np.append(np.zeros(len(found), bool), True))  # null is the item
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), size, np.int32)), places], schema=schema)

    having = items.mapInArrow(run, "size int, shingle bigint").groupBy("size", "shingle").agg(F.count("*").alias("n"))
    held = having.filter(F.col("shingle").isNull() | (F.col("n") > 1)).toArrow()
    out = {}
    for size in held["size"].unique().to_pylist():
        own = held.filter(pc.equal(held["size"], size))
        rest = own.filter(pc.is_valid(own["shingle"]))
        total = own.filter(pc.is_null(own["shingle"]))["n"][0].as_py()
        out[size] = total, rest["shingle"].to_numpy().view(np.uint64), rest["n"].to_numpy()
    return out


def indexes(benchmark, radius=RADIUS, threshold=SIMILARITY, id_col="item_id", text_col="text", block=BLOCK, block_bytes=BLOCK_BYTES):
    """Indexes over all items, each of about `block` items and `block_bytes` bytes at most, one at a time."""
    items = texts(benchmark, id_col, text_col)
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // block), -(-size // block_bytes))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    counts = _counts(items) if blocks > 1 else None
    for k in range(blocks):
        rows = sorted(((r["doc_id"], r["text"]) for r in numbered.filter(F.col("block") == k).toLocalIterator()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        yield Index(rows, radius, threshold, counts)


MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("bits", pa.int32())])


def contaminated(docs, benchmark, radius=RADIUS, threshold=SIMILARITY, id_col="doc_id", text_col="text", **options):
    """One row per document and item found in it: doc_id, item_id, similarity, start_word, n_words, bits."""
    rows = texts(docs, id_col, text_col)

    def found(index):
        def run(batches):
            for batch in batches:
                out = [(i, *m) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for m in index(t)]
                if out:
                    yield emit(out, MATCH)

        return rows.mapInArrow(run, "doc_id bigint, item_id bigint, similarity double, start_word bigint, n_words bigint, bits int")

    whole = None
    for index in indexes(benchmark, radius, threshold, **options):
        whole = found(index) if whole is None else whole.unionByName(found(index))
    return whole


def clean(docs, benchmark, radius=RADIUS, threshold=SIMILARITY, text_col="text", **options):
    """The documents in which no item was found, all columns as they are."""
    for index in indexes(benchmark, radius, threshold, **options):
        docs = _without(docs, index, text_col)
    return docs


def _without(docs, index, text_col):
    def run(batches):
        for batch in batches:
            keep = pa.array([not index(t or "") for t in batch[text_col].to_pylist()], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)
