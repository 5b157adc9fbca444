r"""Chat formatting of typed content parts, in DataFrame operations only.

A message is an ordered array of parts (struct<kind, text, ref, size>; kinds text, image, audio,
document). The visitor flattens them into one string: text is escaped, every attachment becomes a
placeholder ``<|kind:i|>`` numbered in order, its reference is recorded, and its expanded token count
follows from its size. A turn is ``<|im_start|>role\ntext<|im_end|>\n``.

Escaping puts one more backslash between ``<`` and ``|`` where only backslashes stand between them, so no text
can hold ``<|``; reading back takes one away. That is reversible for every text. In a role, a line feed
is written as ``<|lf|>``, which no escaped role can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|lf|>"
PART = "array<struct<kind:string,text:string,ref:string,size:double>>"
#: Tokens of an attachment: fixed ones, and ones for each unit of its size (image tiles, seconds, pages).
EXPANSION = {"image": (85, 170), "audio": (2, 25), "document": (4, 800)}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_parts(text: Column) -> Column:
    """A plain text as the only part of a message; null is empty."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("size"))
    return F.array(part).cast(PART)


def _tokens(kind: Column, size: Column) -> Column:
    out = F.lit(0.0)
    for name, (fixed, each) in EXPANSION.items():
        out = F.when(kind == name, fixed + each * F.ceil(F.coalesce(size, F.lit(1.0)))).otherwise(out)
    return out.cast("long")


def merged_text(parts: Column) -> Column:
    """Adjacent text parts become one, so that no control string can arise where two of them meet."""
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    join = lambda a, p: F.struct(F.lit("text").alias("kind"), F.concat(F.coalesce(a["text"], F.lit("")), F.coalesce(p["text"], F.lit(""))).alias("text"), a["ref"].alias("ref"), a["size"].alias("size"))
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, p: F.when((F.size(acc) > 0) & is_text(p) & is_text(F.get(acc, F.size(acc) - 1)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(join(last(acc), p))).cast(PART)).otherwise(F.concat(acc, F.array(p)).cast(PART))
    return F.when(F.size(parts) < 2, parts).otherwise(F.aggregate(parts, F.array().cast(PART), step))


def flatten_parts(parts: Column) -> dict[str, Column]:
    """The visitor: content (escaped text with placeholders), attachments (in order), attachment_tokens.

    A null array or part is empty; an unknown kind counts as an attachment without tokens.
    """
    known = merged_text(F.filter(F.coalesce(parts, F.array().cast(PART)), lambda p: p.isNotNull()))
    others = F.filter(known, lambda p: ~F.coalesce(p["kind"], F.lit("text")).eqNullSafe(F.lit("text")))
    attachments = F.transform(others, lambda p, i: F.struct(i.alias("position"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p["kind"], p["size"]).alias("tokens")))
    # placeholders are numbered by the attachments before them in the message
    number = lambda i: F.size(F.filter(F.slice(known, 1, i + 1), lambda q: ~F.coalesce(q["kind"], F.lit("text")).eqNullSafe(F.lit("text")))) - 1
    pieces = F.transform(known, lambda p, i: F.when(F.coalesce(p["kind"], F.lit("text")) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), escape(p["kind"]), F.lit(":"), number(i).cast("string"), F.lit("|>"))))
    return {"content": F.array_join(pieces, ""), "attachments": attachments, "attachment_tokens": F.aggregate(attachments, F.lit(0).cast("long"), lambda a, p: a + p["tokens"])}


def format_chats(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask, attachments, attachment_tokens, n_turns.

    messages: conv_id, turn, role, parts. Turns come in order of turn (nulls first), ties by role and
    content, and repeated rows stay as turns of their own; a null role is an empty one; a null conv_id
    is a conversation. loss_mask has a struct (turn, start, length, offset) per turn that is trained on: the content
    at start in that turn's block, and its offset in formatted, all in code points. A conversation is one
    string, so its rows meet in one task; nothing but the conversation is gathered there.
    """
    role = F.regexp_replace(escape(F.coalesce(F.col("role"), F.lit(""))), "\n", LINE)
    flat = flatten_parts(F.col("parts"))
    rows = messages.select("conv_id", "turn", role.alias("role"), F.coalesce(F.col("role"), F.lit("")).isin(*loss_roles).alias("in_loss"), *[c.alias(n) for n, c in flat.items()])
    rows = rows.withColumn("block", F.concat(F.lit(START), "role", F.lit("\n"), "content", F.lit(END)))
    rows = rows.withColumn("block_chars", F.length("block")).withColumn("start", F.length("role") + len(START) + 1).withColumn("chars", F.length("content")).drop("content")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "block")
    rows = rows.withColumn("at", F.row_number().over(order) - 1).withColumn("before", F.sum("block_chars").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_chars"))
    turn = F.struct("at", "block", "in_loss", "start", "chars", "before", "attachments")
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.count("*").alias("n_turns"), F.sum("attachment_tokens").alias("attachment_tokens"))
    mask = F.transform(F.filter("turns", lambda t: t["in_loss"]), lambda t: F.struct(t["at"].alias("turn"), t["start"].alias("start"), t["chars"].alias("length"), (t["before"] + t["start"]).alias("offset")))
    return chats.select("conv_id", F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"), mask.alias("loss_mask"), F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"), "attachment_tokens", "n_turns")


def read_back(chats: DataFrame) -> DataFrame:
    """The turns (role, text; unescaped) and the text under the loss mask, from formatted and loss_mask alone.

    Splitting once and looking turns up by number keeps this linear in the length of a conversation.
    """
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")
    head = r"^<\|im_start\|>([^\n]*)\n"
    parsed = chats.withColumn("blocks", blocks)
    role = lambda b: unescape(F.regexp_replace(F.regexp_extract(b, head, 1), r"<\|lf\|>", "\n"))
    turns = F.transform("blocks", lambda b: F.struct(role(b).alias("role"), unescape(F.regexp_replace(b, head, "")).alias("text")))
    under = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("blocks")[m["turn"]], m["start"] + 1, m["length"])))
    return parsed.select("*", turns.alias("read_turns"), F.array_join(under, "").alias("loss_text"))
