"""Spelling variants of words, by reduced alphabets.

Words are maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z in lower case, counted over all documents; a
task counts its own words first, so a word costs one row a task, however common it is. A run whose checksum with its
document's id is a multiple of `every` loses the letter the checksum names.

Letters are hashed to a few symbols. For each distinct reduced word its neighbourhood of one edit is generated and joined
with the reduced vocabulary; the words behind two reduced words that meet are compared as they are, inside the join, so only
words that differ by exactly one inserted, deleted or replaced code point come out of it. An edit of a word is the same
edit of its reduced word, or none, so no pair is lost. Each pair of reduced words is generated once: an insertion is a
deletion from the longer word, and a replacement goes from the lesser symbol to the greater. Keys are 48-bit hashes; what
collides is sorted out by the comparison. More `symbols` mean more keys and fewer comparisons, and the same result.

A word's form is its near word of greatest count (then least in code-point order), if that is at least `ratio` times its own
count; its root is where forms lead, which takes fewer than 20 steps as counts grow tenfold with each.

Null and empty texts have no words; a null id is written as nothing before the colon; repeated rows count again; an empty
table has no word. Words may be of any length.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kilowatch.llm.common import _power, mix, texts, written

EVERY = 31
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
SYMBOLS = 6
ROUNDS = 5  # doublings of a path to the root: 32 steps; counts below 2^63 allow 18
HELD_BYTES = 32 << 20  # of words a task counts before it hands them on

_RUN = rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}"  # UTF-8 of a-z and U+00C0 to U+00FF
#: Letters from the most to the least common, so that common ones get different symbols.
_COMMON = "etaoinshrdlucmfwypvbgkjqxz"
_LETTERS = _COMMON + "".join(chr(c) for c in range(0xC0, 0x100))


# ---- words ----------------------------------------------------------------------------------------------------------


def _counted(least, every):
    run = re.compile(_RUN % least)

    def words(data, doc_id):
        """(word, occurrences) of one text, from its UTF-8 bytes in lower case."""
        start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        for word, n in Counter(run.findall(data)).items():
            h = zlib.crc32(word, start)
            if h % every == 0:
                letters = word.decode()
                at = h % len(letters)
                letters = letters[:at] + letters[at + 1 :]
                if len(letters) < least:
                    continue
                word = letters.encode()
            yield word, n

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    def run_all(batches):
        found, held = {}, 0
        for rows in batches:
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                for word, n in words(text.as_buffer().to_pybytes().lower(), doc_id):
                    before = found.get(word)
                    if before is None:
                        held += len(word) + 64
                        found[word] = n
                    else:
                        found[word] = before + n
                if held > HELD_BYTES:
                    yield batch(found)
                    found, held = {}, 0
        yield batch(found)

    return run_all


def vocabulary(docs, least_length=LEAST_LENGTH, least_count=LEAST_COUNT, every=EVERY, id_col="doc_id", text_col="text"):
    """(word, n) of all words of at least so many code points and occurrences."""
    rows = texts(docs, id_col, text_col).mapInArrow(_counted(least_length, every), "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# ---- reduced words --------------------------------------------------------------------------------------------------

_BASE = 0xC2B2AE3D27D4EB4F  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def _reduced(word, symbols):
    signs = "".join(chr(ord("a") + (k if k < len(_COMMON) else ord(letter)) % symbols) for k, letter in enumerate(_LETTERS))
    return F.translate(word, _LETTERS, signs)


def _keys(codes):
    return (mix(codes) >> np.uint64(16)).astype(np.int64)


class _Codes:
    """Reduced words of a batch as numbers: a word is the sum of its symbols times the powers of a base."""

    def __init__(self, words):
        data = "".join(words).encode("ascii")
        self.symbols = np.frombuffer(data, np.uint8).astype(np.uint64) - np.uint64(ord("a") - 1)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        longest = int(self.lengths.max()) if len(words) else 0
        self.powers = _power(_BASE, max(longest, 1))[np.arange(len(data)) - np.repeat(self.starts, self.lengths)]
        self.terms = self.symbols * self.powers
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.terms, out=self.sums[1:])
        self.whole = self.sums[self.ends] - self.sums[self.starts]

    def neighbours(self, symbols):
        """(key, key of the word) of every word itself, less one symbol, and with one symbol replaced by a greater one."""
        own = _keys(self.whole)
        yield own, own
        of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        before = self.sums[:-1] - self.sums[self.starts][of]
        last = np.ones(len(of), bool)  # of equal symbols in a row one deletion is enough
        last[:-1] = (self.symbols[:-1] != self.symbols[1:]) | (of[:-1] != of[1:])
        shorter = before + (self.whole[of] - before - self.terms) * _INVERSE
        yield _keys(shorter[last]), own[of[last]]
        for symbol in range(2, symbols + 1):
            less = self.symbols < symbol
            at = of[less]
            yield _keys(self.whole[at] + (np.uint64(symbol) - self.symbols[less]) * self.powers[less]), own[at]


def _neighbourhoods(symbols):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for near, own in _Codes(batch.column(0).to_pylist()).neighbours(symbols):
                    for at in range(0, len(near), 1 << 18):
                        arrays = [pa.array(near[at : at + (1 << 18)]), pa.array(own[at : at + (1 << 18)])]
                        yield pa.RecordBatch.from_arrays(arrays, ["near", "own"])

    return run


def _keyed(batches):
    for batch in batches:
        keys = _keys(_Codes(batch.column(2).to_pylist()).whole)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], ["word", "n", "reduced", "own"])


def near_pairs(words, symbols=SYMBOLS):
    """(word, n, other, other_n) of words (word, n) that differ by exactly one edit, each pair once."""
    coded = words.select("word", "n", _reduced(F.col("word"), symbols).alias("reduced"))
    coded = written(coded.mapInArrow(_keyed, "word string, n bigint, reduced string, own bigint"), "vocabulary")
    edits = coded.select("reduced").distinct().mapInArrow(_neighbourhoods(symbols), "near bigint, own bigint")
    known = coded.select(F.col("own").alias("near")).distinct()
    meet = edits.join(known.hint("shuffle_hash"), "near")
    first = coded.select("own", "word", "n").join(meet, "own")
    second = coded.select(F.col("own").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    apart = (first["own"] != first["near"]) | (first["word"] < second["other"])
    one_edit = F.levenshtein(first["word"], second["other"], 1) == 1
    found = first.join(second, (first["near"] == second["near"]) & apart & one_edit)
    # Two reduced words with one key would find a pair twice.
    return coded, found.select("word", "n", "other", "other_n").distinct()


# ---- forms ----------------------------------------------------------------------------------------------------------


def _roots(links):
    """(word, root) of all words with a form, by doubling the way gone."""
    gone = links.select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        further = gone.select(F.col("word").alias("root"), F.col("root").alias("next"))
        gone = written(gone.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if gone.filter("moved").isEmpty():
            break
        gone = gone.drop("moved")
    return gone.select("word", "root")


def variants(docs, least_length=LEAST_LENGTH, least_count=LEAST_COUNT, ratio=RATIO, symbols=SYMBOLS, every=EVERY, id_col="doc_id", text_col="text"):
    """One row per word: word, n, n_near, form, form_n, root."""
    words, pairs = near_pairs(vocabulary(docs, least_length, least_count, every, id_col, text_col), symbols)
    either = F.array(
        F.struct(F.col("word"), F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    sided = pairs.select(F.explode(either).alias("side")).select("side.*")
    best = sided.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    held = words.select("word", "n").join(best, "word", "left")
    common = -F.col("best.less") >= ratio * F.col("n")
    held = held.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(common, F.col("best.near")).alias("form"),
        F.when(common, -F.col("best.less")).alias("form_n"),
    )
    held = written(held, "forms")
    roots = _roots(held.filter(F.col("form").isNotNull()))
    return held.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
