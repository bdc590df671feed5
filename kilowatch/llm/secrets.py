"""Secret scans in SQL functions: patterns, and sliding-window entropy over candidate strings.

Base kinds are `assign`, `access` and `hex` (patterns below), leftmost and non-overlapping for each kind. Added kinds,
`entropy_hex` and `entropy_text`, are runs of at least `WINDOW` characters with a digit in which some window of that
length has a Shannon entropy at or over the threshold of its character class; the span runs from the first such window
to the end of the last. The counts of a window follow from those of the window before: one character enters, one
leaves. Candidates that match the allow list, and spans within a base span, are not added; base spans always stay.

Positions are code points, ends exclusive. A null or empty text has no spans; texts of any length are scanned whole, in
time that grows with their length, and no pattern repeats a group, which Java would follow by recursion; repeated rows and null ids come back as they are.
"""

import math

from pyspark.sql import functions as F

from kilowatch.llm.common import bound, texts

# The base kinds in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run of less is shorter from any later place in it as well
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_text")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Characters of a class and the least entropy, in bits, of a window that is reported.
HEX_CLASS = "0123456789abcdefABCDEF"
TEXT_CLASS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
THRESHOLDS = {"entropy_hex": 3.0, "entropy_text": 3.8}
# Strings that look random but are no secrets.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"(?!.*[-_/=+]{2})[A-Za-z]([A-Za-z_/=+-]*[A-Za-z])?[0-9]{0,4}",  # words, paths and numbered names; no group repeats
    r"[0-9/_=+-]+",  # numbers, dates
    r".*EXAMPLE.*",
)
MASK = "[SECRET]"

CHUNK = 512  # pieces of a text that are walked over together
BLOCK = 1024  # characters of a text that are cut together
BASE_KINDS = 3

_MARK = "\x01"
_SPAN = "struct<start:int,rank:int,end:int>"


def _clean(text):
    """The text with the mark's character replaced by another one that no pattern knows."""
    return F.translate(text, _MARK, "\x02")


def _scanned(items, state, step, kind):
    """All outputs of a walk over an array, in order: step(state, item) gives the next state, an output and whether it counts.

    The walk goes by chunks, so an output is copied within its chunk and once more, not once for each later output.
    """
    nothing = F.array().cast(f"array<{kind}>")

    def one(acc, item):
        after, out, counts = step(acc["state"], item)
        return F.struct(after.alias("state"), F.when(counts, F.concat(acc["out"], F.array(out))).otherwise(acc["out"]).alias("out"))

    def chunk(acc, part):
        walked = F.aggregate(part, F.struct(acc["state"].alias("state"), nothing.alias("out")), one)
        return bound(walked, lambda w: F.struct(w["state"].alias("state"), F.concat(acc["out"], F.array(w["out"])).alias("out")))

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(CHUNK)), lambda k: F.slice(all_, k + 1, CHUNK))
    start = F.struct(state.alias("state"), F.array(nothing).alias("out"))
    return F.flatten(F.aggregate(bound(items, cut), start, chunk, lambda acc: acc["out"]))


def _found(text, pattern, span_of):
    """Spans of the matches of a pattern; span_of(match, start) gives the span of a match, or null.

    Matches are marked, and the text is split at the marks: what lies at odd places has matched.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    state = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"))

    def step(seen, piece):
        after = F.struct((seen["at"] + F.length(piece)).alias("at"), (~seen["match"]).alias("match"))
        return after, F.struct(seen["at"].alias("at"), piece.alias("match")), seen["match"]

    matches = _scanned(pieces, state, step, "struct<at:int,match:string>")
    return F.filter(F.transform(matches, lambda m: span_of(m["match"], m["at"])), lambda s: s.isNotNull())


def _span(kind, start, end):
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.cast("int").alias("end"))


def _whole(kind, holds=None):
    def span(match, start):
        one = _span(kind, start, start + F.length(match))
        return one if holds is None else F.when(holds(match), one)

    return span


def _base(text):
    """Arrays of the spans of the base kinds."""
    long_enough = lambda match: F.length(F.regexp_extract(match, ASSIGN, 2)) >= 8
    return [_found(text, ASSIGN, _whole("assign", long_enough)), _found(text, ACCESS, _whole("access")), _found(text, HEX, _whole("hex"))]


def _weight(count):
    """count * log2(count) of the counts a window can have."""
    return F.get(F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 1))), count)


def _windows(candidate, alphabet, threshold):
    """(first, last): start of the first and end of the last window of the candidate at or over the threshold, or nulls.

    A step sees the letter that enters and the one that leaves, paired once for the whole candidate, and moves their counts.
    """
    letters = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    before = lambda all_: F.concat(F.array_repeat(F.lit(-1), WINDOW), F.slice(all_, 1, F.greatest(F.size(all_) - WINDOW, F.lit(0))))
    pair = lambda enters, leaves: F.struct(enters.alias("enters"), leaves.alias("leaves"))
    pairs = bound(letters, lambda all_: F.zip_with(all_, before(all_), pair))
    state = F.struct(
        F.lit(0).alias("n"),
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
        F.lit(0.0).cast("double").alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def step(s, p):
        enters, leaves = p["enters"], p["leaves"]
        up, down = F.get(s["counts"], enters), F.get(s["counts"], leaves)
        total = s["sum"] + F.when(enters == leaves, F.lit(0.0)).otherwise(
            _weight(up + 1) - _weight(up) + F.when(leaves >= 0, _weight(down - 1) - _weight(down)).otherwise(F.lit(0.0))
        )
        moved = lambda: F.transform(s["counts"], lambda v, k: v + (k == enters).cast("int") - (k == leaves).cast("int"))

        def after(total):
            # The sum is compared in units far above what additions of doubles lose.
            over = (s["n"] >= WINDOW - 1) & (F.round(F.lit(math.log2(WINDOW)) - total / WINDOW, 9) >= threshold)
            return F.struct(
                (s["n"] + 1).alias("n"),
                F.when(enters == leaves, s["counts"]).otherwise(moved()).alias("counts"),
                total.alias("sum"),
                F.when(s["first"].isNull() & over, s["n"] - (WINDOW - 1)).otherwise(s["first"]).alias("first"),
                F.when(over, s["n"] + 1).otherwise(s["last"]).alias("last"),
            )

        return bound(total, after)

    return F.aggregate(pairs, state, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _entropy(text):
    """Spans of the added kinds, before those within base spans are dropped."""

    def of(kind, alphabet, candidate, start):
        hit = lambda w: F.when(w["first"].isNotNull(), _span(kind, start + w["first"], start + w["last"]))
        return bound(_windows(candidate, alphabet, THRESHOLDS[kind]), hit)

    def span(candidate, start):
        allowed = candidate.rlike("^(" + "|".join(f"(?:{p})" for p in ALLOWED) + ")$")
        return F.when(candidate.rlike("[0-9]") & ~allowed,
            F.when(candidate.rlike("^[0-9a-fA-F]+$"), of("entropy_hex", HEX_CLASS, candidate, start))
            .otherwise(of("entropy_text", TEXT_CLASS, candidate, start)))

    return _found(text, CANDIDATE, span)


def _beside(base, more):
    """Base spans and those of `more` that no base span holds, in order: one walk by start, with the farthest end of a base
    span so far. Base kinds come first at one start, as their ranks do."""
    added = lambda s: s["rank"] >= BASE_KINDS
    step = lambda reach, s: (F.when(added(s), reach).otherwise(F.greatest(reach, s["end"])), s, ~added(s) | (s["end"] > reach))
    return _scanned(F.sort_array(F.concat(base, more)), F.lit(0), step, _SPAN)


def with_spans(rows, text):
    """Add `base` and `spans` (base and added), arrays of (start, rank of the kind, end) in that order."""
    held = rows.withColumn("_clean", _clean(text))
    held = held.withColumn("_base", F.array(*_base(F.col("_clean")))).withColumn("_more", _entropy(F.col("_clean")))
    held = held.withColumn("base", F.sort_array(F.flatten("_base")))
    held = held.withColumn("spans", F.when(F.size("_more") == 0, F.col("base")).otherwise(_beside(F.col("base"), F.col("_more"))))
    return held.drop("_clean", "_more")


def _as_text(spans):
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def scan(docs, id_col="doc_id", text_col="text"):
    """One row per document: doc_id, number of spans of each base kind, digest of the base spans, all spans."""
    found = with_spans(texts(docs, id_col, text_col), F.col("text"))
    counts = [F.size(F.col("_base")[k]).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:3])]
    added = (F.size("spans") - F.size("base")).cast("bigint").alias("n_entropy")
    return found.select("doc_id", *counts, F.sha2(_as_text(F.col("base")), 256).alias("base_sha256"), _as_text(F.col("spans")).alias("spans"), added)


def _masked(text, spans, mask):
    """The text with spans masked: what lies between them is cut from blocks of the text, not from its start each time."""
    whole = F.length(text)
    end = F.struct(whole.alias("start"), F.lit(len(KINDS)).alias("rank"), whole.alias("end"))
    gap = lambda at, s: F.struct(at.alias("start"), s["start"].alias("end"), (s["rank"] < len(KINDS)).alias("masked"))
    step = lambda at, s: (F.greatest(at, s["end"]), gap(at, s), s["start"] >= at)
    gaps = _scanned(F.concat(spans, F.array(end)), F.lit(0), step, "struct<start:int,end:int,masked:boolean>")

    def cut(blocks, g):
        first, last = F.floor(g["start"] / BLOCK).cast("int"), F.floor((g["end"] - 1) / BLOCK).cast("int")
        low = lambda k: F.greatest(g["start"] - k * BLOCK, F.lit(0))
        part = lambda k: F.substring(F.get(blocks, k), low(k) + 1, F.least(g["end"] - k * BLOCK, F.lit(BLOCK)) - low(k))
        kept = F.when(g["end"] > g["start"], F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise(F.lit(""))
        return F.concat(kept, F.when(g["masked"], F.lit(mask)).otherwise(F.lit("")))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.array_join(bound(blocks, lambda all_: F.transform(gaps, lambda g: cut(all_, g))), "")


def redacted(docs, text_col="text", mask=MASK):
    """The documents with every span replaced by the mask; overlapping spans become one. `n_chars` follows, if there."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs[text_col].cast("string").alias("_text"))
    found = with_spans(rows, F.coalesce("_text", F.lit("")))
    text = F.when(F.size("spans") > 0, _masked(F.col("_text"), F.col("spans"), mask)).otherwise(F.col("_text"))
    changed = found.select("_row", text.alias("_new"))
    length = F.length("_new").cast("bigint")
    new = {text_col: F.col("_new"), **({"n_chars": F.when(F.col("_new").isNull(), F.col("_row.n_chars")).otherwise(length)} if "n_chars" in docs.columns else {})}
    return changed.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
