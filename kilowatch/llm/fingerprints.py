"""Document fingerprints: bottom-k sketches of shingle hashes.

The sketch of a text is its `K` least different hashes of five-word shingles (ASCII letters in lower case; fewer words
make one shingle, a text without words has none). It says how many different shingles there are, and two sketches say
how much two texts resemble or contain each other. Sketches of parts merge into the sketch of the whole, so a text of
any length is sketched part by part, and `merged` sketches groups of any size with one sketch per task and group.

As text a sketch is the base64 form of its hashes, big-endian in ascending order; equal texts give equal sketches.
Null and empty texts have the empty sketch. Two empty sketches resemble each other fully, one empty one not at all.
"""

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kilowatch.llm.common import SHINGLE_WORDS, IdRanges, emit, shingle_hashes, shuffle_partitions, texts, word_hashes

K = 128
_PART = 1 << 16
_ROWS = 256


# ---- sketches -------------------------------------------------------------------------------------------------------


def merge(*sketches, k=K):
    """Sketch of the union."""
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.zeros(0, np.uint64)


def sketch(text, k=K, size=SHINGLE_WORDS):
    words = word_hashes(text.encode().lower())
    if len(words) <= _PART:
        return merge(shingle_hashes(words, size), k=k)
    kept = np.zeros(0, np.uint64)
    for at in range(0, len(words) - size + 1, _PART):  # parts overlap by the words a shingle shares with the next
        kept = merge(kept, shingle_hashes(words[at : at + _PART + size - 1], size), k=k)
    return kept


def encode(hashes):
    return base64.b64encode(hashes.astype(">u8").tobytes()).decode()


def decode(text):
    return np.frombuffer(base64.b64decode(text or ""), ">u8").astype(np.uint64)


def distinct(a, k=K):
    """Estimated number of different shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1)


def resemblance(a, b, k=K):
    """Estimated share of common shingles among all: the share of the union's sketch that both have."""
    union = merge(a, b, k=k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def containment(a, b, k=K):
    """Estimated share of a's shingles that b has as well."""
    own, union = distinct(a, k), distinct(merge(a, b, k=k), k)
    return min(1.0, resemblance(a, b, k) * union / own) if own else 1.0


# ---- tables ---------------------------------------------------------------------------------------------------------


def fingerprints(docs, k=K, size=SHINGLE_WORDS, id_col="doc_id", text_col="text"):
    """(doc_id, fingerprint, n_shingles) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("n_shingles", pa.float64())])

    def run(batches):
        for batch in batches:
            found = [sketch(t, k, size) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([encode(s) for s in found], pa.string()), pa.array([distinct(s, k) for s in found], pa.float64())], schema=schema)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fingerprint string, n_shingles double")


def merged(prints, group_col, k=K, fingerprint_col="fingerprint"):
    """(group, fingerprint): the sketch of all texts of a group.

    Every task first merges what it has of a group, then random halves of the tasks' results are merged, then those:
    however large a group is, no task gets more than a share of its sketches. Null fingerprints are empty, null groups
    are a group.
    """
    rows = prints.select(F.col(group_col).alias("grouping"), F.col(fingerprint_col).alias("fingerprint"))
    kind = rows.schema["grouping"].dataType.simpleString()

    def local(batches):
        held = {}

        def out():
            names, values = list(held), [encode(s) for s in held.values()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, group_type), pa.array(values, pa.string())], ["grouping", "fingerprint"])

        group_type = None
        for batch in batches:
            group_type = batch.schema.field("grouping").type
            for group, text in zip(batch["grouping"].to_pylist(), batch["fingerprint"].to_pylist(), strict=True):
                held[group] = merge(held[group], decode(text), k=k) if group in held else merge(decode(text), k=k)
            if len(held) > 20_000:
                yield out()
        if held:
            yield out()

    def together(table):
        whole = merge(*(decode(t) for t in table["fingerprint"].to_pylist()), k=k)
        return pa.table([table["grouping"][:1], pa.array([encode(whole)])], names=["grouping", "fingerprint"])

    schema = f"grouping {kind}, fingerprint string"
    partial = rows.mapInArrow(local, schema).withColumn("salt", F.spark_partition_id() % 64)
    halves = partial.groupBy("grouping", "salt").applyInArrow(together, schema)
    return halves.groupBy("grouping").applyInArrow(together, schema).withColumnRenamed("grouping", group_col)


# ---- a text and its neighbour ---------------------------------------------------------------------------------------


def edited(text, following):
    """The text whose last quarter of code points is replaced by the first as many of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def with_next(docs, visit, schema, id_col="doc_id", text_col="text"):
    """A row visit(doc_id, text, state, next text, next state) per document; `state` is visit.prepare(text).

    Next is the document after it by ascending doc_id, after the last comes the first; equal ids go by text, null ids
    come first. Texts are shuffled once, into ranges of ids; the first document of a range is also sent to the range
    before. A range is read in order, two documents at a time.
    """
    rows = texts(docs, id_col, text_col)
    ranges = IdRanges(rows.select("doc_id"), shuffle_partitions(docs.sparkSession))
    count = len(ranges)
    place = rows.withColumn("place", ranges.of(F.col("doc_id")).cast("int"))
    own = F.struct(F.col("place").alias("part"), F.lit(0).alias("guest"))
    guest = F.struct(F.pmod(F.col("place") + F.lit(count - 1), F.lit(count)).cast("int").alias("part"), F.lit(1).alias("guest"))
    sent = F.when(ranges.starts(F.col("doc_id"), F.col("place")), F.array(own, guest)).otherwise(F.array(own))
    dealt = place.select("doc_id", "text", F.explode(sent).alias("at")).select("at.part", "at.guest", "doc_id", "text")
    ordered = dealt.repartitionById(count, F.col("part")).sortWithinPartitions("part", "guest", "doc_id", "text")

    def run(batches):
        before, done, out = None, False, []
        for batch in batches:
            for guest, doc_id, text in zip(batch["guest"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if done:
                    break
                now = (doc_id, text, visit.prepare(text))
                if before is not None:
                    out.append(visit(*before, text, now[2]))
                before, done = now, bool(guest)
                if len(out) >= _ROWS:
                    yield emit(out, schema)
                    out = []
        if out:
            yield emit(out, schema)

    return ordered.mapInArrow(run, ", ".join(f"{f.name} {_SQL[str(f.type)]}" for f in schema))


_SQL = {"int64": "bigint", "string": "string", "double": "double"}


class EditedFingerprints:
    """What op2 returns of a document, its edited text and its neighbour."""

    SCHEMA = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
        + [(c, pa.float64()) for c in ("near_edited", "near_next", "kept_in_edited", "n_shingles", "n_shingles_edited")]
    )

    def __init__(self, k=K, size=SHINGLE_WORDS):
        self.k, self.size = k, size

    def prepare(self, text):
        return sketch(text, self.k, self.size)

    def __call__(self, doc_id, text, own, following, other):
        changed = edited(text, following)
        new, k = sketch(changed, self.k, self.size), self.k
        digest = hashlib.sha256(changed.encode()).hexdigest()
        return (
            doc_id, len(text), digest, encode(own), encode(new),
            resemblance(own, new, k), resemblance(own, other, k), containment(own, new, k), distinct(own, k), distinct(new, k),
        )


def edited_fingerprints(docs, k=K, size=SHINGLE_WORDS, id_col="doc_id", text_col="text"):
    visit = EditedFingerprints(k, size)
    return with_next(docs, visit, visit.SCHEMA, id_col, text_col)
