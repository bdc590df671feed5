"""SimHash near-dedup by anchor points.

Two fingerprints of 64 bits within 4 bits of each other are within 2 bits in their upper or within 1 bit in their lower
half, so each half is covered by itself. The anchors of a half are the words of a covering code: 31 bits in the words of
the (31, 26) Hamming code, whose covering radius is 1, and one free bit. Two halves within t bits have a word in between
that is at most ceil(t / 2) from either, and an anchor within 1 of that word. So every fingerprint is replicated to all
anchors within covering radius plus that share of the threshold, 2 bits for either half: 17 anchors of 2^27. Any linked
pair meets at an anchor; comparing all 64 bits there is exact. Nothing is lost and no cell is capped.

At an anchor, linked fingerprints are grown into groups, and only a spanning tree is handed on, never all pairs. Cells
of more than `CELL` fingerprints are cut into blocks, and pairs of blocks are compared by different tasks.

Null texts are empty; texts without words have fingerprint zero, which is linked like any other. Equal texts share one
fingerprint and are compared once. A null doc_id is no candidate for the smallest id of a component (which is null if
it has no other); repeated rows come back as often as they came in; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from kilowatch.llm.common import majority, texts, written

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
CELL = 4096
_BLOCK = 1 << 14


# ---- fingerprints ---------------------------------------------------------------------------------------------------


def fingerprint(text, size=SHINGLE_WORDS):
    """Majority of the XXH64 hashes of the shingles of a text, as an unsigned number."""
    words = text.encode().lower().split()  # bytes know only ASCII letters and white space
    if not words:
        return 0
    size = min(size, len(words))
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    starts = np.concatenate(([0], gaps + 1))[: len(words) - size + 1]
    ends = np.concatenate((gaps, [len(line)]))[size - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = [
        np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + _BLOCK].tolist(), ends[k : k + _BLOCK].tolist())], np.uint64)
        for k in range(0, len(starts), _BLOCK)
    ]
    return majority(np.concatenate(hashes))


def fingerprints(docs, size=SHINGLE_WORDS, id_col="doc_id", text_col="text"):
    """(doc_id, fp, text_hash): fp holds the 64 bits as a signed number."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found), batch["text_hash"]], ["doc_id", "fp", "text_hash"])

    return texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id bigint, fp bigint, text_hash bigint")


# ---- anchors --------------------------------------------------------------------------------------------------------


def _syndromes(values):
    """Syndrome of the upper 31 bits of 32-bit words: the xor of the places, 1 to 31, of the set bits."""
    found = np.zeros(len(values), np.int64)
    for place in range(1, 32):
        found ^= place * ((values >> place) & 1)
    return found


def _patterns(radius):
    """By syndrome, the flips of at most `radius` of 32 bits that turn a word of that syndrome into an anchor."""
    by = [[] for _ in range(32)]

    def grow(pattern, syndrome, first, left):
        by[syndrome].append(pattern)
        for place in range(first, 32) if left else ():
            grow(pattern | 1 << place, syndrome ^ place, place + 1, left - 1)

    grow(0, 0, 0, radius)
    return by


def shares(max_bits):
    """Bits either half may differ by so that every pair within max_bits is within one of them."""
    upper = (max_bits + 1) // 2
    return upper, max_bits - upper - 1


class Anchors:
    """Anchors of the code that a half of a fingerprint has to visit."""

    COVERING_RADIUS = 1

    def __init__(self, threshold):
        radius = self.COVERING_RADIUS + (threshold + 1) // 2
        by = _patterns(radius)
        width = max(map(len, by))
        self.flips = np.array([p + [0] * (width - len(p)) for p in by], np.int64)
        self.used = np.array([[k < len(p) for k in range(width)] for p in by])

    def of(self, halves):
        """(index of the half, anchor) of all visits."""
        syndromes = _syndromes(halves)
        row, column = np.nonzero(self.used[syndromes])
        return row, halves[row] ^ self.flips[syndromes[row], column]


def visits(prints, max_bits):
    """(cell, fp): each fingerprint at each of its anchors, in either half."""
    upper, lower = shares(max_bits)

    def run(batches):
        halves = [(1, 32, Anchors(upper))] + ([(0, 0, Anchors(lower))] if lower >= 0 else [])
        for batch in batches:
            fps = batch["fp"].to_numpy()
            for k in range(0, len(fps), 4096):
                block = fps[k : k + 4096]
                for tag, shift, anchors in halves:
                    row, anchor = anchors.of((block >> shift) & 0xFFFFFFFF)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor + (tag << 32)), pa.array(block[row])], ["cell", "fp"])

    return prints.mapInArrow(run, "cell bigint, fp bigint")


# ---- comparison within a cell ---------------------------------------------------------------------------------------


def _grown(fps, max_bits):
    """Spanning trees of the linked groups among different fingerprints: (member, root), no row for the roots."""
    left, found = fps, []
    while len(left):
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= max_bits
            if near.any():
                joined, left = left[near], left[~near]
                frontier.extend(joined)
                found.append(np.stack([joined, np.full(len(joined), root)], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), fps.dtype)


def _blocks(cell, fps, size):
    """The members of a large cell, replicated so that each pair of blocks meets in a cell of its own."""
    count = -(-len(fps) // size)
    for i in range(count):
        mine = fps[i * size : (i + 1) * size]
        for j in range(count):
            pair = f"{cell}:{min(i, j)}:{max(i, j)}"
            yield np.full(len(mine), xxhash.xxh64_intdigest(pair, 1), np.uint64).view(np.int64), mine


def _links(max_bits, limit):
    """Batches sorted by cell to batches of (a, b, part). Cells over the limit give (member, null, new cell)."""

    def cells(cell, fp):
        """Complete cells of sorted arrays."""
        starts = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1))
        sizes = np.diff(np.concatenate((starts, [len(cell)])))
        pairs = starts[sizes == 2]
        a, b = fp[pairs], fp[pairs + 1]
        near = (np.bitwise_count(a ^ b) <= max_bits) & (a != b)
        found = [np.stack([b[near], a[near]], axis=1)]
        for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            members = np.unique(fp[at : at + size])
            if limit and len(members) > limit:
                for part, mine in _blocks(int(cell[at]), members, limit):
                    yield mine, None, part
            else:
                found.append(_grown(members, max_bits))
        trees = np.concatenate(found)
        yield trees[:, 0], trees[:, 1], None

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int64())])

        def out(a, b, part):
            empty = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), empty if b is None else pa.array(b.view(np.int64)), empty if part is None else pa.array(part)], schema=schema
            )

        cell, kept = None, []

        def flush():
            fps = np.concatenate(kept)
            yield from cells(np.full(len(fps), cell, np.int64), fps)

        def found():
            nonlocal cell, kept
            for batch in batches:
                if not len(batch):
                    continue
                now, fps = batch["cell"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
                if cell is not None and now[0] != cell:
                    yield from flush()
                    kept = []
                last = int(np.searchsorted(now, now[-1]))  # the last cell may go on in the next batch
                if last:
                    yield from cells(np.concatenate([np.full(sum(map(len, kept)), cell or 0, np.int64), now[:last]]), np.concatenate([*kept, fps[:last]]))
                    kept = []
                cell = int(now[-1])
                kept.append(fps[last:].copy())
            if kept:
                yield from flush()

        for a, b, part in found():
            if len(a):
                yield out(a, b, part)

    return run


def _compared(members, max_bits, limit):
    dealt = members.repartition("cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(_links(max_bits, limit), "a bigint, b bigint, part bigint")


def links(prints, max_bits=MAX_BITS, limit=CELL):
    """Links (a, b) among different fingerprints whose connected groups are those of all links within max_bits."""
    first = written(_compared(visits(prints, max_bits), max_bits, limit), "simhash-links")
    rest = first.filter("part IS NOT NULL").select(F.col("part").alias("cell"), F.col("a").alias("fp"))
    more = _compared(rest, max_bits, 0)
    return first.filter("part IS NULL").select("a", "b").unionByName(more.select("a", "b"))


# ---- groups ---------------------------------------------------------------------------------------------------------


def _min_by_node(rows):
    return rows.groupBy("u").agg(F.min("v").alias("m"))


def components(edges):
    """(node, root) for all nodes of the edges (a, b): the least node of each connected group.

    Alternates large stars and small stars until nothing moves; a logarithmic number of rounds. Each star takes the least
    neighbour by a pre-aggregated grouping and a join that Spark can split, so a node with very many edges is no obstacle.
    """
    spark = edges.sparkSession
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_min_by_node(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = written(large, "large-stars")
        small = large.join(_min_by_node(large), "u")
        stars = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = written(stars.distinct(), "small-stars")
        before, state = state, tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before or not state[0]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_groups(docs, size=SHINGLE_WORDS, max_bits=MAX_BITS, id_col="doc_id", text_col="text"):
    """(doc_id, fp, text_hash, component_id) for every row of docs."""
    prints = written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = written(components(links(distinct.select("fp"), max_bits)), "roots")
    member = roots.join(distinct, roots["node"] == distinct["fp"]).select("root", "fp", "least")
    of_root = written(member.groupBy("root").agg(F.min("least").alias("component_id")), "root-ids")
    linked = written(member.join(of_root, "root").select("fp", "component_id"), "linked")
    every = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(written(every, "classes"), "fp").select("doc_id", "fp", "text_hash", "component_id")


def near_duplicates(docs, size=SHINGLE_WORDS, max_bits=MAX_BITS, id_col="doc_id", text_col="text"):
    """One row per document: doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    found = near_groups(docs, size, max_bits, id_col, text_col)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs, size=SHINGLE_WORDS, max_bits=MAX_BITS, id_col="doc_id", text_col="text"):
    """The documents without all but one of each group: its smallest id stays, at equal ids the least text hash."""
    found = near_groups(docs, size, max_bits, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    # A group is named by its component_id; documents without any id in their group are told apart by fingerprint.
    stays = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")).agg(first.alias("one"))
    none, key = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))
    stays = stays.select("one.*").select(none.alias("_none"), key.alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("_hash"))
    keyed = rows.select("_row", none.alias("_none"), key.alias("_key"), "_hash")
    same = ["_none", "_key", "_hash"]
    return keyed.join(written(stays, "stays"), same, "left_semi").dropDuplicates(same).select("_row.*")
