"""Chat formatting in Spark expressions: turns are collected, sorted, merged by role and joined into one text a conversation.

Template: `<s>`, then for each run of adjacent turns with the same role `<|turn:ROLE|>`, the turns' texts with `<|next|>`
between them, and `<|end|>`, and `</s>` last. In roles and texts the characters & < > [ are written as entities, so no
control string, of this template or one with square brackets, can stand inside a text, and reading turns them back.
The loss mask is run-length coded: (chars, in_loss) over the code points of the formatted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END, HEAD, HEAD_END, NEXT, TURN_END = "<s>", "</s>", "<|turn:", "|>", "<|next|>", "<|end|>"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def _run(chars: Column | int, in_loss: Column | bool = False) -> Column:
    return F.struct((chars if isinstance(chars, Column) else F.lit(chars)).cast("int").alias("chars"), (in_loss if isinstance(in_loss, Column) else F.lit(in_loss)).alias("in_loss"))


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """A row for each conv_id: formatted text and loss_mask.

    Turns stand in order of (turn, role, text); a null turn comes last, a null role or text counts as empty, repeated
    rows are turns of their own, and rows without a conv_id are one conversation. An empty table gives no rows; other
    columns are not read. A conversation is one text, so its turns do meet in one row.
    """
    t = conversations.select("conv_id", F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    t = t.withColumn("starts", starts)
    t = t.withColumn("blocks", F.transform("starts", lambda s, k: F.struct(
        escape(F.get("turns", s)["role"]).alias("role"),
        (F.get("turns", s)["role"] == loss_role).alias("in_loss"),
        F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), n) - s), lambda x: escape(x["text"])).alias("texts"),
    )))
    body = F.transform("blocks", lambda b: F.concat(F.lit(HEAD), b["role"], F.lit(HEAD_END), F.array_join(b["texts"], NEXT), F.lit(TURN_END)))
    mask = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(_run(F.char_length(b["role"]) + len(HEAD + HEAD_END))),
        F.flatten(F.transform(b["texts"], lambda x, i: F.array(_run(F.when(i == 0, 0).otherwise(len(NEXT))), _run(F.char_length(x), b["in_loss"])))),
        F.array(_run(len(TURN_END))),
    )))
    mask = F.filter(F.concat(F.array(_run(len(BEGIN))), mask, F.array(_run(len(END)))), lambda r: r["chars"] > 0)
    return t.select("conv_id", F.concat(F.lit(BEGIN), F.array_join(body, ""), F.lit(END)).alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted: Column | str) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    whole = F.col(formatted) if isinstance(formatted, str) else formatted
    body = F.substring(whole, F.lit(len(BEGIN) + 1), F.char_length(whole) - len(BEGIN + END))
    blocks = F.split(body, r"<\|end\|>", -1)
    head = lambda b: F.substring_index(b, HEAD_END, 1)
    texts = lambda b: F.split(F.substring(b, F.char_length(head(b)) + len(HEAD_END) + 1, F.char_length(b)), r"<\|next\|>", -1)
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda b: F.transform(texts(b), lambda x: F.struct(unescape(F.substring(head(b), F.lit(len(HEAD) + 1), F.char_length(b))).alias("role"), unescape(x).alias("text")))))


def read_loss(formatted: Column | str, mask: Column | str) -> Column:
    """The unescaped text under the loss mask; null where the runs of the mask don't fit the formatted text.

    Control strings begin with < and end with >, which escaped texts don't hold, so a cut before each < and after each >
    gives the pieces that the mask's runs count.
    """
    pieces = F.filter(F.split(formatted, r"(?=<)|(?<=>)", -1), lambda p: p != "")
    fits = F.forall(F.zip_with(pieces, mask, lambda p, r: F.char_length(p).eqNullSafe(r["chars"])), lambda x: x)
    return F.when(fits, F.array_join(F.zip_with(pieces, mask, lambda p, r: F.when(r["in_loss"], unescape(p)).otherwise("")), ""))
