"""Prefix trie of conversations, by time-forward processing.

Conversations are rebuilt as paths of turns, sorted by path, and dealt into shards by ranges of it, so each shard holds a
stretch of the trie in depth-first order, however many conversations share a first turn or are copies of each other.

1.  A shard's stream of sorted paths names its nodes: a path that follows another one closes the nodes they don't share.
    Nodes on the first and on the last path of a shard may have members in other shards: the rim. All others are closed.
2.  The nodes of a shard are sorted by level, deepest first (Spark's external sort). Each takes the messages sent to it
    from a priority queue that spills sorted runs, adds its own part, and sends the totals of its subtree to its parent.
    Messages come by (level, parent, smallest member), so a node knows its own smallest member when the first one is read,
    and hands on its children's rows one by one; nothing is gathered per node.
3.  The rim's parts, at most two paths a shard, are merged by prefix and processed in the same way across shards.

Turns go by (turn, digest of role and text), null turns first; null roles and texts are empty; repeated rows are turns of
their own. A turn is known by 128 bits of a SHA-256. Rows without a conv_id belong to no conversation and are left out;
an empty table has no node. A conversation's path takes 20 bytes a turn in one row; its texts are read once and never
shuffled. The members that end at one node are hashed in one stream, as SHA-256 has to be, a megabyte of ids at a time.

Runs spilled by a queue lie in files of the task that have no name and end with it; a task that is run again makes its own.
"""

import hashlib
import heapq
import pickle
import struct
import tempfile
import zlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import functions as F

from kilowatch.llm.common import emit, shuffle_partitions, written

FAMILY = 20  # a conversation's first turns are those of the one whose id is the last multiple of this
HEADS = 4  # first turns taken over: a hash modulo this
UNIT = 20  # bytes of a turn in a path: digest and number of words
ROOM = 200_000  # messages a queue keeps in memory
RUNS = 64  # spilled runs before they are merged
BLOCK = 2_000  # messages or rows that are written together
ENDS_BYTES = 1 << 20  # of ids that are hashed together

WORD = r"[^\x20\x09-\x0D]+"


class SpillingQueue:
    """Smallest tuple first; what is beyond `room` lies in sorted runs on disk."""

    def __init__(self, room=ROOM):
        self.room, self.near, self.runs = room, [], []

    def push(self, message):
        heapq.heappush(self.near, message)
        if len(self.near) > self.room:
            self._spill(sorted(self.near))
            self.near = []
            if len(self.runs) > RUNS:
                runs, self.runs = self.runs, []
                self._spill(heapq.merge(*(chain((head,), rest) for head, _, rest in runs)))

    def _spill(self, messages):
        file = tempfile.TemporaryFile()
        block = []
        for message in messages:
            block.append(message)
            if len(block) == BLOCK:
                pickle.dump(block, file, pickle.HIGHEST_PROTOCOL)
                block = []
        if block:
            pickle.dump(block, file, pickle.HIGHEST_PROTOCOL)
        file.seek(0)
        rest = self._read(file)
        heapq.heappush(self.runs, (next(rest), id(file), rest))

    @staticmethod
    def _read(file):
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def least(self):
        """The smallest message, or None."""
        if self.runs and (not self.near or self.runs[0][0] < self.near[0]):
            return self.runs[0][0]
        return self.near[0] if self.near else None

    def pop(self):
        if self.runs and (not self.near or self.runs[0][0] < self.near[0]):
            least, key, rest = self.runs[0]
            following = next(rest, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, key, rest))
            return least
        return heapq.heappop(self.near)


# ---- paths ----------------------------------------------------------------------------------------------------------

_PATHS = pa.schema([("conv_id", pa.int64()), ("path", pa.binary())])


def _turns(conversations, conv_col, turn_col, role_col, text_col):
    """(family, conv_id, turn, unit): a turn as the 20 bytes it takes in a path."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = empty(role_col), empty(text_col)
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(said, 256)), 1, 16)
    words = F.unhex(F.lpad(F.hex(F.regexp_count(text, F.lit(WORD))), 8, "0"))
    conv = F.col(conv_col).cast("bigint")
    return conversations.select(
        (conv - conv % FAMILY).alias("family"), conv.alias("conv_id"), F.col(turn_col).alias("turn"), F.concat(digest, words).alias("unit")
    ).filter(F.col("conv_id").isNotNull())


def heads_of(conv_id):
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _rebuilt(batches):
    """Paths of whole families: rows come family by family, the base first, each conversation's turns in order."""
    family = conv = None
    base, own, rows = [], [], []

    def path():
        taken = heads_of(conv)
        first = own if conv == family else base
        return b"".join(first[:taken]) + b"".join(own[taken:])

    for batch in batches:
        columns = (batch.column(k).to_pylist() for k in range(3))
        for new_family, new_conv, unit in zip(*columns, strict=True):
            if new_conv != conv or new_family != family:
                if conv is not None:
                    rows.append((conv, path()))
                    if conv == family:
                        base = own[:HEADS]
                if new_family != family:
                    base = []
                family, conv, own = new_family, new_conv, []
                if len(rows) >= BLOCK:
                    yield emit(rows, _PATHS)
                    rows = []
            own.append(unit)
    if conv is not None:
        rows.append((conv, path()))
    yield emit(rows, _PATHS)


def paths(conversations, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """(conv_id, path) of every conversation, rebuilt: the first turns of its family's base, then its own."""
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    order = ["family", F.col("conv_id") != F.col("family"), "conv_id", "turn", "unit"]
    held = turns.repartition(shuffle_partitions(turns.sparkSession), "family").sortWithinPartitions(*order)
    return held.select("family", "conv_id", "unit").mapInArrow(_rebuilt, "conv_id bigint, path binary")


# ---- nodes of a shard -----------------------------------------------------------------------------------------------

#: kind 0: a node. kind 1: ids of members that end at the node `digest`, hashed later.
_NODES = pa.schema([
    ("kind", pa.int32()), ("depth", pa.int64()), ("number", pa.int64()), ("parent", pa.int64()), ("words", pa.int64()), ("rim", pa.bool_()), ("digest", pa.binary()),
    ("parent_digest", pa.binary()), ("ends", pa.int64()), ("first_end", pa.int64()), ("ends_sha256", pa.string()), ("ids", pa.binary()),
])
_NODES_SQL = (
    "kind int, depth bigint, number bigint, parent bigint, words bigint, rim boolean, digest binary, parent_digest binary, "
    "ends bigint, first_end bigint, ends_sha256 string, ids binary"
)


class _Node:
    __slots__ = ("number", "words", "digest", "ends", "first_end", "ids", "size", "long")

    def __init__(self, number, words, digest):
        """Nodes of a shard's first path know their digest, and thereby that they are of the rim."""
        self.number, self.words, self.digest, self.ends, self.first_end = number, words, digest, 0, None
        self.ids, self.size, self.long = [], 0, False

    def end(self, conv_id):
        if not self.ends:
            self.first_end = conv_id
        self.ends += 1
        text = str(conv_id)
        self.ids.append(text)
        self.size += len(text) + 1


def _prefixes(path):
    """Digests of all prefixes of a path, the empty one first."""
    sha = hashlib.sha256()
    found = [sha.digest()[:16]]
    for at in range(0, len(path), UNIT):
        sha.update(path[at : at + UNIT])
        found.append(sha.copy().digest()[:16])
    return found


def _shared(a, b):
    """Turns two paths have in common."""
    most, low = min(len(a), len(b)) // UNIT, 0
    if a[: most * UNIT] == b[: most * UNIT]:
        return most
    while most - low > 1:  # the paths agree in `low` turns, but not in `most`
        middle = (low + most) // 2
        if a[low * UNIT : middle * UNIT] == b[low * UNIT : middle * UNIT]:
            low = middle
        else:
            most = middle
    return low


def _shard_nodes(batches):
    """Nodes of the sorted paths of a shard, and ids of those members whose digest can't be closed here."""
    stack, rows, last, numbered = [], [], None, 0

    def piece(node, depth, digest):
        """Ids so far, to be hashed later. Pieces of a node are ordered by their first ids."""
        node.long = True
        rows.append((1, depth, node.number, None, None, None, digest, None, None, int(node.ids[0]), None, ",".join(node.ids).encode()))
        node.ids, node.size = [], 0

    def close(final=None):
        """Close the deepest open node; `final` has the digests of the last path, which is of the rim."""
        node, depth = stack.pop(), len(stack)
        digest = final[depth] if final else node.digest
        rim = digest is not None
        if node.ends and (rim or node.long):
            if digest is None:
                digest = hashlib.sha256(last[: depth * UNIT]).digest()[:16]
            if node.ids:
                piece(node, depth, digest)
            sha = None
        else:
            sha = hashlib.sha256(",".join(node.ids).encode()).hexdigest()
        above = (final[depth - 1] if final else stack[-1].digest) if rim and depth else None
        parent = stack[-1].number if stack else None
        rows.append((0, depth, node.number, parent, node.words, rim, digest, above, node.ends, node.first_end, sha, None))

    for batch in batches:
        for conv_id, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            digests = _prefixes(path) if last is None else None
            shared = -1 if last is None else _shared(last, path)
            while len(stack) - 1 > shared:
                close()
            for depth in range(len(stack), len(path) // UNIT + 1):
                words = struct.unpack(">I", path[depth * UNIT - 4 : depth * UNIT])[0] if depth else 0
                stack.append(_Node(numbered, words, digests and digests[depth]))
                numbered += 1
            last, node = path, stack[-1]
            node.end(conv_id)
            if node.size > ENDS_BYTES:
                piece(node, len(stack) - 1, node.digest or hashlib.sha256(path).digest()[:16])
            if len(rows) >= BLOCK:
                yield emit(rows, _NODES)
                rows.clear()
    final = _prefixes(last) if stack else None
    while stack:
        close(final)
        if len(rows) >= BLOCK:
            yield emit(rows, _NODES)
            rows.clear()
    yield emit(rows, _NODES)


# ---- time-forward processing ----------------------------------------------------------------------------------------

#: kind 0: done. kind 1: done but for the parent's conv_id, a rim node. kind 2: what this shard knows of a rim node.
#: kind 3: ids to hash, handed on.
_TOTALS = pa.schema([
    ("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("digest", pa.binary()), ("parent_digest", pa.binary()), ("words", pa.int64()),
    ("ends", pa.int64()), ("number", pa.int64()), ("parent", pa.int64()), ("ids", pa.binary()),
])
_TOTALS_SQL = (
    "kind int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
    "ends_sha256 string, digest binary, parent_digest binary, words bigint, ends bigint, number bigint, parent bigint, ids binary"
)


def _pass_up(nodes, room):
    """Rows of a shard's nodes, deepest level first and by number within a level.

    A node is a tuple (depth, number, parent, words, rim, digest, parent digest, own members, smallest own member, digest of
    the own ones, own totals), or (None, a row to hand on). A child's message is (-depth and number of the parent, conv_id, ..., its totals).
    """
    queue = SpillingQueue(room)
    for node in nodes:
        if node[0] is None:
            yield node[1]
            continue
        depth, number, parent, words, rim, digest, above, ends, first_end, sha, (n_convs, n_children, n_leaves, saved) = node
        conv_id = first_end
        while (least := queue.least()) is not None and least[:2] == (-depth, number):
            _, _, child_conv, child, its_convs, its_children, its_leaves, its_saved, its_sha, its_digest = queue.pop()
            if conv_id is None or child_conv < conv_id:
                conv_id = child_conv  # messages come by conv_id: true for the first one at most
            n_convs, n_children, n_leaves, saved = n_convs + its_convs, n_children + 1, n_leaves + its_leaves, saved + its_saved
            # The parent of a closed child is known unless it has members elsewhere.
            known = (0, child_conv, depth + 1, conv_id) if not rim else (1, child_conv, depth + 1, None)
            yield (*known, its_convs, its_children, its_leaves, its_saved, its_sha, its_digest, None, None, None, child, number, None)
        if rim:
            yield (2, conv_id, depth, None, n_convs, n_children, n_leaves, saved, sha, digest, above, words, ends, number, parent, None)
        else:
            saved += (n_convs - 1) * words
            queue.push((1 - depth, parent, conv_id, number, n_convs, n_children, n_leaves or 1, saved, sha, digest))


def _batched(rows):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= BLOCK:
            yield emit(held, _TOTALS)
            held = []
    yield emit(held, _TOTALS)


def _rows(batches, *names):
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names), strict=True)


def _shard_totals(room):
    def nodes(batches):
        for kind, depth, number, *rest, ids in _rows(batches, *_NODES.names):
            if kind == 1:
                digest, start = rest[3], rest[6]
                yield None, (3, start, depth, None, None, None, None, None, None, digest, None, None, None, number, None, ids)
            else:
                yield depth, number, *rest, (rest[5], 0, 0, 0)

    return lambda batches: _batched(_pass_up(nodes(batches), room))


def _rim_totals(room):
    """The rim's nodes, merged by prefix and numbered by digest."""

    def nodes(batches):
        names = ("depth", "digest", "parent_digest", "words", "conv_id", "sha", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
        for depth, digest, above, words, conv_id, sha, n_convs, n_children, n_leaves, saved, ends in _rows(batches, *names):
            yield depth, digest, above or b"", words, False, digest, None, ends, conv_id, sha, (n_convs, n_children, n_leaves, saved)
        # What stands above the root takes its message, and hands on its row.
        yield -1, b"", None, 0, False, None, None, 0, None, None, (0, 0, 0, 0)

    def rows(batches):
        for row in _pass_up(nodes(batches), room):
            yield (*row[:3], row[3] if row[2] else None, *row[4:13], None, None, None)

    return lambda batches: _batched(rows(batches))


_SHA = pa.schema([("digest", pa.binary()), ("late_sha256", pa.string())])


def _hashed(batches):
    """Digest of the ids of each node, piece after piece."""
    now, sha, rows = None, None, []
    for batch in batches:
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest != now:
                if now is not None:
                    rows.append((now, sha.hexdigest()))
                now, sha = digest, hashlib.sha256(ids)
            else:
                sha.update(b",")
                sha.update(ids)
    if now is not None:
        rows.append((now, sha.hexdigest()))
    yield emit(rows, _SHA)


def trie(conversations, room=ROOM, **columns):
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    spark = conversations.sparkSession
    shards = shuffle_partitions(spark)
    found = written(paths(conversations, **columns), "paths")
    held = found.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = held.select("conv_id", "path").mapInArrow(_shard_nodes, _NODES_SQL)
    # Reverse level order within each shard: a sort of its own rows, no exchange.
    levels = nodes.sortWithinPartitions(F.desc("depth"), "number")
    totals = levels.mapInArrow(_shard_totals(room), _TOTALS_SQL).withColumn("shard", F.spark_partition_id())
    totals = written(totals, "subtrees")

    parts = totals.filter("kind = 2")
    merged = parts.groupBy("digest").agg(
        F.max("depth").alias("depth"), F.max("parent_digest").alias("parent_digest"), F.max("words").alias("words"), F.min("conv_id").alias("conv_id"),
        F.when(F.sum("ends") == 0, F.max("ends_sha256")).alias("sha"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends")),
    )
    rim = merged.repartition(1).sortWithinPartitions(F.desc("depth"), "digest").mapInArrow(_rim_totals(room), _TOTALS_SQL)
    rim = written(rim, "rim")

    # What a rim node is called, for its closed children in each shard: few rows a shard, no key that all shards share.
    called = parts.select("shard", F.col("number").alias("parent"), "digest").join(rim.select("digest", F.col("conv_id").alias("rim_conv_id")), "digest").drop("digest")
    below = totals.filter("kind = 1").join(called, ["shard", "parent"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "digest"]
    below = below.withColumn("parent_conv_id", F.col("rim_conv_id")).select(*columns)
    every = totals.filter("kind = 0").select(*columns).unionByName(below).unionByName(rim.select(*columns))

    pieces = totals.filter("kind = 3").select("digest", F.col("conv_id").alias("start"), "ids")
    pieces = pieces.repartition(shards, "digest").sortWithinPartitions("digest", "start").select("digest", "ids")
    late = pieces.mapInArrow(_hashed, "digest binary, late_sha256 string")
    here = every.filter("ends_sha256 IS NOT NULL").select(*columns[:-1])
    there = every.filter("ends_sha256 IS NULL").join(late, "digest", "left").withColumn("ends_sha256", F.col("late_sha256"))
    return here.unionByName(there.select(*columns[:-1]))
