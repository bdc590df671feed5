"""Helpers the operators share: narrow inputs, written intermediate tables, word and shingle hashes, id ranges."""

import pickle
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kilowatch.session import shared_folder

SHINGLE_WORDS = 5
SIMILARITY = 0.8


def texts(docs, id_col="doc_id", text_col="text"):
    """(doc_id, text) and nothing else, so that further columns of the input can't clash; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def written(frame, purpose):
    """The frame as a Parquet table in the folder all executors share: cuts lineage, is computed once."""
    path = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def bound(value, use):
    """use(value) with the value worked out once: an expression named inside a lambda is evaluated each time the lambda is."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shuffle_partitions(spark):
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def emit(rows, schema):
    """One record batch of a list of tuples."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def spilled(rows, block=2000):
    """Rows written to a file of the task that has no name, read back a block at a time."""
    file, held = tempfile.TemporaryFile(), []
    for row in rows:
        held.append(row)
        if len(held) == block:
            pickle.dump(held, file, pickle.HIGHEST_PROTOCOL)
            held = []
    pickle.dump(held, file, pickle.HIGHEST_PROTOCOL)
    file.seek(0)

    def read():
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    return read()


class Memory:
    """Results by key, of bounded size: what was used lately stays, the rest is forgotten in halves."""

    def __init__(self, find, size):
        self.find, self.size, self.now, self.before = find, size // 2, {}, {}

    def __call__(self, key):
        """For keys that are not in `now`, which callers look at first."""
        found = self.before.get(key)
        if found is None:
            found = self.now.get(key)
            if found is None:
                found = self.find(key)
        if len(self.now) >= self.size:
            self.before = dict(self.now)
            self.now.clear()
        self.now[key] = found
        return found


# ---- hashes of words and shingles, many at a time -------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2^64
_UNBASE = pow(_BASE, -1, 1 << 64)
_FOLD = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)
_SEGMENT = 1 << 20
_powers = {}


def _power(base, n):
    """base^0 .. base^(n-1) modulo 2^64, kept for later calls."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:n]


def mix(h):
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII that is neither letter nor digit.
NOT_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def _spans(data, breaks):
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~breaks[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _word_hashes(data, breaks):
    starts, ends = _spans(data, breaks)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_UNBASE, len(data))[starts])


def word_hashes(raw, breaks=WHITE):
    """One 64-bit hash per word of the bytes. Long texts are hashed in segments that end between words."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) <= _SEGMENT:
        return _word_hashes(data, breaks)
    parts, start = [], 0
    while start < len(data):
        end = start + _SEGMENT
        while end < len(data):
            gaps = np.flatnonzero(breaks[data[end : end + _SEGMENT]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += _SEGMENT
        parts.append(_word_hashes(data[start:end], breaks))
        start = end
    return np.concatenate(parts)


def shingle_hashes(words, size=SHINGLE_WORDS):
    """Hashes of all runs of `size` words, repeats included; fewer words make one run, none make no run."""
    if not len(words):
        return words
    size = min(size, len(words))
    count = len(words) - size + 1
    folded = words[:count] * _FOLD[0]
    for k in range(1, size):
        folded = folded + words[k : k + count] * _FOLD[k]
    return mix(folded + np.uint64(size))


def set_bits(hashes):
    """How many of the hashes have each of the 64 bits set, lowest bit first."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = np.ascontiguousarray(hashes[at : at + (1 << 15)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def majority(hashes):
    """64-bit number whose bits are set in more than half of the hashes; 0 without hashes."""
    over = set_bits(hashes) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


# ---- ranges of ids --------------------------------------------------------------------------------------------------


class IdRanges:
    """Ranges of about equally many rows by ascending id.

    The bounds are ids of the table, found from the id column alone, and are literals of the plan: a task that is run
    again deals its rows out as before. Range k starts with the id `bounds[k]`; null ids are in the first range.
    """

    def __init__(self, ids, ranges):
        places = [k / ranges for k in range(1, ranges)]
        found = ids.agg(
            F.min("doc_id").alias("least"), F.percentile_approx("doc_id", places or [0.5], 20 * ranges + 1000).alias("cuts")
        ).first()
        cuts = (found["cuts"] or []) if places else []
        self.bounds = sorted({*cuts, found["least"]}) if found["least"] is not None else [0]

    def __len__(self):
        return len(self.bounds)

    def of(self, column):
        """Range of an id, by bisection."""
        bounds = F.array(*(F.lit(b).cast("bigint") for b in self.bounds)) if len(self) < 64 else self._long()
        steps = [1 << k for k in reversed(range((len(self) - 1).bit_length()))]
        if not steps:
            return F.lit(0)
        step = lambda low, s: F.when(F.get(bounds, low + s) <= column, low + s).otherwise(low)
        return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), step)

    def _long(self):
        return F.from_json(F.lit(str(self.bounds)), "array<bigint>")

    def starts(self, column, place):
        """Whether the id is the first of its range; null ids come before all others."""
        bounds = F.array(*(F.lit(b).cast("bigint") for b in self.bounds)) if len(self) < 64 else self._long()
        return F.coalesce(F.get(bounds, place) == column, F.lit(True))
