"""Token ids as flat binary files.

Layout of a folder, written by Spark's own writers so that any file system it knows will do:

    flat/kind=ids/range=K/*       the ids of the documents of range K, each an unsigned little-endian integer of 2 or 4
                                  bytes, document after document in ascending doc_id, the end id after each document
    flat/kind=lengths/range=K/*   16 bytes a document: doc_id (signed, 64 bits), its number of ids, the end id
    docs/range=K/*                16 bytes a document: doc_id (signed) and where its ids start, counted over all ranges
                                  (unsigned), both 64-bit little-endian
    ranges/                       Parquet: range, its first id's place (`base`), number of documents and ids

A range's base is the prefix sum of the ranges before it. Ranges go by ascending doc_id and hold about equally many
documents; those with more than `RANGE_BYTES` of text are cut further, down to the documents of one id (those without an id
stay with the least one). Files can be memory-mapped (`Tokens`) where the folder is mounted, and read by Spark anywhere
(`read_documents`).

The text writer ends each row with a separator of at least one byte: in `flat` it is the end id, in `docs` the upper
bytes of the 64-bit number, which are zero, as starts stay below 2^48 (checked).

Null texts are empty documents: the end id alone. Null ids come first and are stored as the least 64-bit number; equal
ids go by a hash of the text. An empty table gives files without ids.
"""

import glob
import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from kilowatch.llm.common import IdRanges, emit, shuffle_partitions, texts

END_ID = 0
NO_ID = -(1 << 63)
LIMIT = 1 << 48
RANGE_BYTES = 128 << 20  # of text; a range's file is read as a whole
WORDS = 300_000  # a task remembers, twice
LONG = 64  # characters of a part that goes to the tokenizer as it is
ROWS, BATCH_BYTES = 4000, 8 << 20  # of documents whose parts are encoded together


# ---- tokens ---------------------------------------------------------------------------------------------------------


# Fixed value: the splitter of byte-level BPE.
SPLITTER = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library, remembering words up to a bound.

    The splitter of such a BPE never joins what lies on both sides of a single space between two characters that are not
    white space, and no merge crosses its splits. So texts are cut there, and the different parts of many texts are split into
    words in one go, with a white space character between them that none of them has. The tokenizer's model encodes each
    new word; Arrow gathers the ids of words, parts and texts. Parts with white space inside are left to the tokenizer as
    they are. The result is the tokenizer's own on the whole texts. With `added`, strings of added tokens in a text get the
    ids of those tokens, as the tokenizer's file has it, and texts that hold one go to the tokenizer whole; else such strings
    are ordinary text.
    """

    MARK = "\x0b"

    def __init__(self, path, width, added=False):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        parts = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in parts["added_tokens"]] if added else []
        splitter = parts["pre_tokenizer"] or {}
        if parts["normalizer"] or splitter.get("type") != "ByteLevel" or not splitter.get("use_regex") or splitter.get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE")
        self.model, self.split = self.tokenizer.model, regex.compile(SPLITTER).findall
        self.odd = regex.compile(r"[^\S\n]").search
        self.kind = {2: "H", 4: "I"}[width]  # the little-endian machines that Spark runs on
        self.words, self.old_words = {}, {}
        # The model's characters for bytes: printable ones stand for themselves, the others are numbered from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.chars = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}

    def _bytes(self, ids):
        return array(self.kind, ids).tobytes()

    def _word(self, word):
        return self._bytes([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.chars))])

    def _text(self, text):
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _known(self, words):
        """The ids of different words."""
        ids = list(map(self.words.get, words))
        for k, found in enumerate(ids):
            if found is None:
                word = words[k]
                found = self.old_words.get(word)
                ids[k] = self.words[word] = self._word(word) if found is None else found
        if len(self.words) > WORDS:
            self.old_words, self.words = self.words, {}
        return ids

    def _parts(self, parts, head):
        """The ids of parts, each after the `head`, as an Arrow array. Parts are no part of a run of white space."""
        strange = {k for k, p in enumerate(parts) if len(p) >= LONG}
        if self.odd("".join(parts)):
            strange |= {k for k, p in enumerate(parts) if self.odd(p)}
        plain = [head + p for k, p in enumerate(parts) if k not in strange] if strange or head else parts
        found = self._joined(plain)
        if not strange:
            return found
        others = pa.array([self._text(head + parts[k]) for k in sorted(strange)], pa.large_binary())
        mask = np.zeros(len(parts), bool)
        mask[list(strange)] = True
        place = np.where(mask, len(found) + np.cumsum(mask) - 1, np.cumsum(~mask) - 1)
        return pa.concat_arrays([found, others]).take(pa.array(place))

    def _joined(self, plain):
        """The ids of strings that can be split side by side."""
        if not plain:
            return pa.array([], pa.large_binary())
        words = pa.array(self.split(self.MARK.join(plain)), pa.string()).dictionary_encode()
        different = words.dictionary.to_pylist()
        try:
            mark = different.index(self.MARK)
            different[mark] = ""
        except ValueError:
            mark = -1  # one string alone
        gathered = pa.array(self._known(different), pa.large_binary()).take(words.indices)
        _, edges, ids = gathered.buffers()
        edges = np.frombuffer(edges, np.int64, len(words) + 1)
        marks = np.flatnonzero(words.indices.to_numpy() == mark)
        bounds = np.concatenate(([0], edges[marks], edges[-1:]))
        return pa.Array.from_buffers(pa.large_binary(), len(plain), [None, pa.py_buffer(bounds), ids])

    def _whole(self, text):
        if any(a in text for a in self.added):
            self.tokenizer.encode_special_tokens = False
            try:
                return self._text(text)
            finally:
                self.tokenizer.encode_special_tokens = True
        pieces = cut(text)
        ids = iter(self._parts([p for p in pieces if type(p) is str], " ").to_pylist())
        return b"".join(next(ids) if type(p) is str else self._text(p[0]) for p in pieces)

    def __call__(self, texts):
        """The ids of each text of an Arrow array as little-endian bytes, in an Arrow array.

        Texts are cut at all spaces; each different part is encoded once, and the ids of all texts are gathered from those. A
        text's first part has no space before it, and a text with a part that belongs to a run of white space is cut again
        on its own: both are entries of their own in place of the first part. So are texts with added tokens.
        """
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        at, count = offsets[:-1] - offsets[0], np.diff(offsets)
        coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        index, slack = coded.indices.to_numpy(), loose_parts(coded.dictionary)
        # Texts that are one loose part are left to the tokenizer too, so that all parts are whole words.
        torn = np.add.reduceat(slack[index], at) > 0 if len(at) else np.zeros(0, bool)
        for added in self.added:
            torn |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        entries = self._parts(coded.dictionary.filter(pa.array(~slack)).to_pylist(), " ")
        firsts = self._parts(coded.dictionary.take(pa.array(index[at[~torn]])).to_pylist(), "")
        wholes = pa.array([self._whole(t) for t in texts.filter(pa.array(torn)).to_pylist()], pa.large_binary())
        none = len(entries)  # loose parts, and parts of torn texts, stand for nothing by themselves
        place = np.where(slack, none, np.cumsum(~slack) - 1)[index]
        place[np.repeat(torn, count)] = none
        place[at] = none + 1 + np.where(torn, len(firsts) + np.cumsum(torn) - 1, np.cumsum(~torn) - 1)
        gathered = pa.concat_arrays([entries, pa.array([b""], pa.large_binary()), firsts, wholes]).take(pa.array(place))
        _, edges, ids = gathered.buffers()
        bounds = np.frombuffer(edges, np.int64, len(place) + 1)[np.append(at, len(place))]
        if bounds[-1] >= 1 << 31:
            raise ValueError("the ids of a batch pass two gigabytes")
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds.astype(np.int32)), ids])


def loose_parts(parts):
    """`loose` of the strings of an Arrow array."""
    trimmed = pc.utf8_trim_whitespace(parts)
    changed = pc.not_equal(pc.binary_length(trimmed), pc.binary_length(parts))
    return pc.or_(changed, pc.equal(pc.binary_length(parts), 0)).to_numpy(zero_copy_only=False)


def loose(part):
    """Whether a part between single spaces belongs to a run of white space."""
    return type(part) is str and (not part or part[0].isspace() or part[-1].isspace())


def cut(text):
    """The text in pieces, each from a single space between characters that are no white space to the next.

    A piece is a string without its space; the first piece, and those with runs of white space, are tuples of the whole.
    """
    parts = text.split(" ")
    out, last = [], (parts[0],)
    for part, before in zip(parts[1:], parts):
        if not part or part[0].isspace() or not before or before[-1].isspace():
            last = (last[0] + " " + part if type(last) is tuple else " " + last + " " + part,)
        else:
            out.append(last)
            last = part
    return [*out, (" " + last,) if loose(last) else last]


_encoders = {}


def encoder(path, width, added=False):
    """One per Python worker and tokenizer."""
    if (path, width, added) not in _encoders:
        _encoders[path, width, added] = Encoder(path, width, added)
    return _encoders[path, width, added]


def _stretches(texts):
    """(start, stop) of rows of bounded number and bytes, a longer text alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = min(max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right"))), at + ROWS)
        yield at, stop
        at = stop


def tokenized(rows, tokenizer, width, added=False):
    """Add `ids` to (doc_id, text, ...) rows in place of the text."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        own = encoder(tokenizer, width, added)
        for whole in batches:
            for at, stop in _stretches(whole["text"]):
                batch = whole.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), own(batch["text"])], [*kept, "ids"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in kept), "ids binary"]))


# ---- files ----------------------------------------------------------------------------------------------------------


def _raw(column):
    """Bytes for the text writer, which writes them as they are."""
    return column.cast("string").alias("value")


def _separator(number, width):
    """The number's bytes as text, one byte a character."""
    return number.to_bytes(width, "little").decode("latin-1")


def _write_rows(rows, path, separator, *folders):
    """Rows sorted by `folders` to one file for each of them."""
    rows.write.partitionBy(*folders).option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def _flat_rows(dealt, width):
    """(kind, range, seq, value) of sorted documents: their ids and their lengths, without the end ids."""

    def run(batches):
        seq = 0
        for batch in batches:
            n = len(batch)
            places, order = batch["range"], pa.array(range(seq, seq + n), pa.int64())
            names = ["kind", "range", "seq", "value"]
            yield pa.RecordBatch.from_arrays([pa.array(["ids"] * n, pa.string()), places, order, batch["ids"]], names)
            out = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                count = len(ids.as_buffer()) // width + 1
                out.append((NO_ID if doc_id is None else doc_id).to_bytes(8, "little", signed=True) + count.to_bytes(8 - width, "little"))
            yield pa.RecordBatch.from_arrays([pa.array(["lengths"] * n, pa.string()), places, order, pa.array(out, pa.binary())], names)
            seq += n

    return dealt.mapInArrow(run, "kind string, range int, seq bigint, value binary")


def _files(spark, path, name, kind=None):
    """(range, name): the bytes of the file of each range."""
    held = spark.read.format("binaryFile").load(path)
    if "range" not in held.columns:  # the folder of an empty table has no files
        return spark.createDataFrame([], f"range int, {name} binary")
    held = held.filter(F.col("kind") == kind) if kind else held
    return held.filter("length > 0").select(F.col("range").cast("int").alias("range"), F.col("content").alias(name))


def _lengths(content, width):
    """doc_ids and numbers of ids in a file of lengths."""
    pairs = np.frombuffer(content, "<i8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1] & ((1 << 8 * (8 - width)) - 1)


def _ranges(rows, count, limit):
    """Ranges of doc_id of about equally many rows, none of more than `limit` bytes of text if it has several ids.

    Ranges over the limit are cut at quantiles of their ids until none is left, all of them in one job each time.
    """
    ranges = IdRanges(rows.select("doc_id"), count)
    cuts = F.percentile_approx("doc_id", [k / 16 for k in range(1, 16)], 1000)
    while True:
        held = rows.groupBy(ranges.of(F.col("doc_id")).alias("range"))
        held = held.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), cuts.alias("cuts"))
        large = held.filter((F.col("bytes") > limit) & (F.col("least") < F.col("most"))).collect()
        if not large:
            return ranges
        for r in large:
            parts = min(16, -(-r["bytes"] // limit))
            own = {r["cuts"][16 * k // parts - 1] for k in range(1, parts)} - {r["least"]}
            ranges.bounds += own or {r["most"]}
        ranges.bounds.sort()


def write_token_files(docs, path, tokenizer, width=2, end_id=END_ID, id_col="doc_id", text_col="text", added_tokens=False):
    """Tokenize every text and write the folder described above; gives the table of its ranges.

    Ids are shuffled once, into ranges of doc_id; the rest works on lengths, 16 bytes a document. With `added_tokens`, ids
    are those of the tokenizer's plain call, also of texts that hold the string of an added token.
    """
    if width not in (2, 4) or not 0 <= end_id < 1 << 8 * width:
        raise ValueError(f"end id {end_id} needs another width than {width} bytes")
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    ranges = _ranges(rows, shuffle_partitions(spark), RANGE_BYTES)
    dealt = tokenized(rows.withColumn("range", ranges.of(F.col("doc_id")).cast("int")).withColumn("tie", F.xxhash64("text")), tokenizer, width, added_tokens)
    dealt = dealt.repartitionById(len(ranges), F.col("range")).sortWithinPartitions("range", "doc_id", "tie")
    flat = _flat_rows(dealt, width).sortWithinPartitions("kind", "range", "seq")
    _write_rows(flat.select("kind", "range", _raw(F.col("value"))), f"{path}/flat", _separator(end_id, width), "kind", "range")

    lengths = _files(spark, f"{path}/flat", "lengths", "lengths")
    bases, base = [], 0
    for place, n_docs, n_ids in sorted(tuple(r) for r in _sums(lengths, width).collect()):  # one row a range
        bases.append((place, base, n_docs, n_ids))
        base += n_ids
    if base >= LIMIT:
        raise ValueError("too many ids for one folder")
    known = spark.createDataFrame(bases, "range int, base bigint, n_docs bigint, n_ids bigint").coalesce(1)
    known.write.parquet(f"{path}/ranges")
    entries = _starts(lengths, {place: base for place, base, _, _ in bases}, width).sortWithinPartitions("range", "start")
    _write_rows(entries.select("range", _raw(F.col("entry"))), f"{path}/docs", "\0\0", "range")
    return known


def _sums(lengths, width):
    """(range, n_docs, n_ids) of the files of lengths."""

    def run(batches):
        for batch in batches:
            out = []
            for place, content in zip(batch["range"].to_pylist(), batch["lengths"], strict=True):
                counts = _lengths(content.as_buffer(), width)[1]
                out.append((place, len(counts), int(counts.sum())))
            yield emit(out, pa.schema([("range", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return lengths.mapInArrow(run, "range int, n_docs bigint, n_ids bigint")


def _starts(lengths, bases, width):
    """(range, start, entry): the first 14 of the 16 bytes a document has in `docs`."""

    def run(batches):
        for batch in batches:
            for place, content in zip(batch["range"].to_pylist(), batch["lengths"], strict=True):
                ids, counts = _lengths(content.as_buffer(), width)
                starts = bases[place] + np.cumsum(counts) - counts
                entries = np.stack([ids, starts], axis=1).astype("<i8").tobytes()
                rows = [(place, start, entries[16 * k : 16 * k + 14]) for k, start in enumerate(starts.tolist())]
                yield emit(rows, pa.schema([("range", pa.int32()), ("start", pa.int64()), ("entry", pa.binary())]))

    return lengths.mapInArrow(run, "range int, start bigint, entry binary")


ENTRY = np.dtype([("doc_id", "<i8"), ("start", "<u8")])


def read_documents(spark, path, width=2):
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files alone.

    A range's ids and documents meet in one task, which looks at its bytes in place; ranges are of bounded size.
    """
    known = spark.read.schema("range int, base bigint, n_docs bigint, n_ids bigint").parquet(f"{path}/ranges")

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for ids, docs, n_ids, base in zip(*(batch[c] for c in ("ids", "docs", "n_ids", "base")), strict=True):
                flat = np.frombuffer(ids.as_buffer(), f"<u{width}")
                entries = np.frombuffer(docs.as_buffer(), ENTRY)
                if len(flat) != n_ids.as_py():
                    raise ValueError("a range's ids are incomplete")
                edges = np.append(entries["start"].astype(np.int64) - base.as_py(), len(flat))
                spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
                crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in spans]
                id_array = pa.array(entries["doc_id"], mask=entries["doc_id"] == NO_ID)
                yield pa.RecordBatch.from_arrays([id_array, pa.array(entries["start"].astype(np.int64)), pa.array(np.diff(edges)), pa.array(crc, pa.int64())], schema=schema)

    whole = _files(spark, f"{path}/flat", "ids", "ids").join(_files(spark, f"{path}/docs", "docs"), "range").join(known, "range")
    return whole.select("ids", "docs", "n_ids", "base").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


class Tokens:
    """A folder that is mounted, memory-mapped: `tokens[k]` are the ids of the k-th document, the end id included."""

    def __init__(self, path, width=2):
        def maps(kind, dtype):
            names = sorted(glob.glob(f"{path}/{kind}/range=*/part-*"), key=lambda f: int(f.split("range=")[1].split("/")[0]))
            return [np.memmap(f, dtype, "r") for f in names if os.path.getsize(f)]

        self.ids, self.docs = maps("flat/kind=ids", f"<u{width}"), maps("docs", ENTRY)
        self.bases = np.cumsum([0, *map(len, self.ids)])
        self.firsts = np.cumsum([0, *map(len, self.docs)])

    def __len__(self):
        return int(self.firsts[-1])

    def _entry(self, k):
        part = int(np.searchsorted(self.firsts, k, "right")) - 1
        return part, k - int(self.firsts[part])

    def doc_id(self, k):
        part, row = self._entry(k)
        return int(self.docs[part]["doc_id"][row])

    def __getitem__(self, k):
        if not 0 <= k < len(self):
            raise IndexError(k)
        part, row = self._entry(k)
        starts, base = self.docs[part]["start"], int(self.bases[part])
        end = int(starts[row + 1]) - base if row + 1 < len(starts) else len(self.ids[part])
        return self.ids[part][int(starts[row]) - base : end]
