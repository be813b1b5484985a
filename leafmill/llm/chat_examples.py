"""Conversations to training examples, one per assistant turn, in DataFrame functions only.

A turn is written `<|turn|>role<|text|>text<|end|>`. An example is a context, all turns
before an assistant turn and the mark of that turn, and a target, its text and the end
mark; only the text is trained on. Turns after the last reply are in no example, so a
conversation that does not end with a reply gets a last row with all turns as context and
no target.

Inside texts and roles every control string (`<|` and the marks of other common templates,
`<s>`, `</s>`, `[INST]`, `[/INST]`, `<SYS>`, `</SYS>`) gets a backslash after its first
character, and one that has backslashes there already gets one more, so that taking one
away gives back any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_REST = r"\||/?s>|/?INST\]|/?SYS>"
_RAW, _ESCAPED = rf"(<|\[)(\\*)({_REST})", rf"(<|\[)\\(\\*)({_REST})"


def escaped(text: Column) -> Column:
    """`text` without control strings."""
    return F.regexp_replace(text, _RAW, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    """The text that `escaped` was given."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def chat_examples(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  trained: str = "assistant") -> DataFrame:
    """(conversation, example, context, target, is_last): an example per turn of role `trained`, numbered from 0.

    `is_last` marks the row that holds the whole conversation; its target is null where no
    reply ends it. One shuffle, of the turns by conversation. Rows go by turn, equal and
    null turns (these first) by role and text; repeated rows count as often as they occur.
    A null role or text is empty; rows without a conversation id are one conversation, and
    an empty table gives no rows. Other columns are not read. Contexts repeat earlier
    turns by the method, so the output grows with the square of a conversation's length;
    each is made as its row is written, none is held beside the others.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = turns.groupBy(F.col(conversation).alias("_conv")).agg(F.sort_array(F.collect_list(row)).alias("_turns"))
    written = F.transform("_turns", lambda t: F.struct((t["role"] == trained).alias("reply"), F.concat(
        F.lit(TURN), escaped(t["role"]), F.lit(TEXT)).alias("mark"), F.concat(escaped(t["text"]), F.lit(END)).alias("text")))
    whole = whole.select("_conv", F.size("_turns").alias("_n"), written.alias("_turns"))
    # a place per reply, and one beyond the end where the last turn is none
    places = F.filter(F.sequence(F.lit(0), F.col("_n")), lambda i: F.when(i < F.col("_n"), F.get("_turns", i)["reply"]).otherwise(
        ~F.get("_turns", F.col("_n") - 1)["reply"]))
    each = whole.select("_conv", "_n", "_turns", F.posexplode(places).alias("example", "_at"))
    before = F.array_join(F.transform(F.slice("_turns", F.lit(1), F.col("_at")), lambda t: F.concat(t["mark"], t["text"])), "")
    reply = F.get("_turns", F.col("_at"))
    return each.select(
        F.col("_conv").alias(conversation), F.col("example").cast("long").alias("example"),
        F.concat(before, F.coalesce(reply["mark"], F.lit(""))).alias("context"), reply["text"].alias("target"),
        (F.col("_at") >= F.col("_n") - 1).alias("is_last"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were before."""
    def parts(piece):
        return F.split(piece, r"<\|text\|>", -1)

    pieces = F.split(formatted, r"<\|end\|>", -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda piece: F.struct(
        unescaped(F.get(parts(piece), F.lit(0)).substr(F.lit(len(TURN) + 1), F.length(piece))).alias("role"),
        unescaped(F.get(parts(piece), F.lit(1))).alias("text")))


def reply_of(target: Column) -> Column:
    """The text a target trains on, unescaped."""
    return unescaped(target.substr(F.lit(1), F.length(target) - len(END)))


def example_columns(examples: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What the examples of each conversation hold, read back from them: turns, trained text, characters written.

    The rows of a conversation lie together already, so nothing is shuffled again.
    """
    full = F.when(F.col("is_last"), F.concat("context", F.coalesce("target", F.lit(""))))
    read = examples.select(conversation, "example", full.alias("_full"), "target",
                           (F.length("context") + F.coalesce(F.length("target"), F.lit(0))).alias("_chars"))
    held = read.groupBy(conversation).agg(
        F.max("_full").alias("_full"), F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", "target")))).alias("_targets"),
        F.sum("_chars").cast("long").alias("formatted_chars"))
    held = held.select(conversation, "formatted_chars", read_turns(F.col("_full")).alias("_turns"),
                       F.array_join(F.transform("_targets", lambda t: reply_of(t["target"])), "").alias("_loss"))
    text = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return held.select(
        conversation, F.size("_turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
