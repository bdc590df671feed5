"""Chat formatting in SQL functions.

The turns of a conversation are collected as structs and sorted by (turn, role, text), so ties have one order. Adjacent
turns of one role become one block. A conversation reads

    <s> [INST] role [/INST] text [+] text </s> ... <<END>>     (without the spaces)

where `[+]` stands between the turns of a block. Control strings inside texts and roles, those of this template and of
other common ones, get a backslash after their first character; a control string that already has backslashes there gets
one more, so the escape is undone exactly. The loss mask covers the texts of assistant turns and no mark.

Null texts and roles are empty, rows with a null conv_id are one conversation, null turns come first; an empty table
gives no conversation. Every step is linear in the length of a conversation.
"""

import re

from pyspark.sql import functions as F

from kilowatch.llm.common import bound

# The marks of the template.
START, BLOCK, BODY, MORE, CLOSE, END = "<s>", "[INST]", "[/INST]", "[+]", "</s>", "<<END>>"
# Control strings of other templates, escaped as well.
RESERVED = ("<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<unk>", "<pad>")
CONTROL = (START, BLOCK, BODY, MORE, CLOSE, END, *RESERVED)
LOSS_ROLES = ("assistant",)

_TAILS = "|".join(re.sub(r"([^\w<>/ ])", r"\\\1", c[1:]) for c in sorted(CONTROL, key=lambda c: (-len(c), c)))
#: First character, backslashes, rest. No mark has a first character inside that could begin another one.
_CONTROL = rf"([<\[])(\\*)({_TAILS})"
_ESCAPED = rf"([<\[])\\(\\*)({_TAILS})"


def escaped(text):
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text):
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _blocks(turns):
    """Array of (role, texts): adjacent turns of one role together."""
    others = lambda all_: F.concat(F.array(F.lit(None).cast("string")), F.transform(all_, lambda t: t["role"]))
    first = lambda t, role: F.struct(t["role"].alias("role"), (~t["role"].eqNullSafe(role)).alias("new"))
    marked = lambda all_: F.zip_with(all_, F.slice(others(all_), 1, F.size(all_)), first)
    places = lambda all_: F.filter(F.transform(marked(all_), lambda t, k: F.when(t["new"], k)), lambda k: k.isNotNull())

    def block(all_, start, stop):
        own = F.slice(all_, start + 1, stop - start)
        return F.struct(F.get(all_, start)["role"].alias("role"), F.transform(own, lambda t: t["text"]).alias("texts"))

    def cut(all_):
        ends = lambda starts: F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(all_)))
        return bound(places(all_), lambda starts: F.zip_with(starts, ends(starts), lambda start, stop: block(all_, start, stop)))

    return bound(turns, cut)


def _segments(blocks, loss_roles):
    """The conversation as pieces (text, loss), in order."""
    mark = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))

    def of(block):
        trained = block["role"].isin(*loss_roles)
        head = F.concat(F.lit(BLOCK), escaped(block["role"]), F.lit(BODY))
        pieces = F.transform(block["texts"], lambda t, k: F.array(mark(F.when(k == 0, head).otherwise(F.lit(MORE))), F.struct(escaped(t).alias("text"), trained.alias("loss"))))
        return F.concat(F.flatten(pieces), F.array(mark(F.lit(CLOSE))))

    return F.concat(F.array(mark(F.lit(START))), F.flatten(F.transform(blocks, of)), F.array(mark(F.lit(END))))


def formatted(conversations, loss_roles=LOSS_ROLES, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """One row per conversation: conv_id, n_blocks, formatted, segments.

    `segments` are the pieces of `formatted` with their loss mask: array of (text, loss).
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).alias("row"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    held = held.select("conv_id", _blocks(F.col("turns")).alias("blocks"))
    held = held.select("conv_id", F.size("blocks").cast("bigint").alias("n_blocks"), _segments(F.col("blocks"), loss_roles).alias("segments"))
    return held.select("conv_id", "n_blocks", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def _without(text, head, tail):
    return F.substring(text, len(head) + 1, F.length(text) - len(head) - len(tail))


def turns_of(text):
    """The turns (role, text) of a formatted conversation."""
    inner = _without(text, START, END)
    # Every block ends with the close mark, so the last part is empty.
    parts = F.filter(F.split(inner, re.escape(CLOSE), -1), lambda p: p != "")

    def turns(part):
        halves = F.split(F.substring(part, len(BLOCK) + 1, F.length(part)), r"\[/INST\]", -1)
        said = lambda role, texts: F.transform(F.split(texts, r"\[\+\]", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))
        return bound(halves, lambda h: bound(unescaped(F.get(h, F.lit(0))), lambda role: said(role, F.get(h, F.lit(1)))))

    return F.flatten(F.transform(parts, turns))


def loss_text(segments):
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def digests(chats):
    """What a formatted conversation says when it is read back."""
    turns = chats.select("conv_id", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"), "formatted", "n_blocks")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "n_blocks",
    )
