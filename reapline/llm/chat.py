"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the rendered text: a conversation is turns end to end, a turn is
``### ROLE: BODY`` and then the line ``</turn>``.  In a body, a control string (``### `` or
``</turn>``) with one or more backslashes before it stands for itself with one backslash
less; a body ends at the first line that is exactly ``</turn>``.  In a role, ``%``, ``:`` and line breaks
are percent codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "\n</turn>\n"
# A run of backslashes is tried once, from its start and as a whole, so time is linear in the text.
CONTROL = r"(\\*+)(### |</turn>)"
NOT_INSIDE = r"(?<!\\)"


def escape(text: Column) -> Column:
    """One more backslash before every control string."""
    return F.regexp_replace(text, NOT_INSIDE + CONTROL, r"$1\\$2")


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, NOT_INSIDE + r"\\" + CONTROL, "$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))


def parse_body(rest: Column) -> Column:
    """The text a parser recovers after a turn's head: up to the first closing line, unescaped."""
    return unescape(F.substring_index(rest, CLOSE, 1))


def render_body(text: Column) -> Column:
    """The text itself if it holds no control string and the parser gives it back unchanged, else the escaped text.

    The escaped form always comes back: no closing line is left in it, and every control
    string has the backslash that the parser takes away.
    """
    free = ~F.contains(text, F.lit("### ")) & ~F.contains(text, F.lit("</turn>"))
    return F.when(free & (parse_body(F.concat(text, F.lit(CLOSE))) == text), text).otherwise(escape(text))


def parse(formatted: Column) -> Column:
    """The turns (role, body, text) of a rendered conversation, by the grammar alone."""
    pieces = F.split(formatted, r"\n</turn>\n", -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        colon = F.instr(piece, ": ")
        return F.struct(
            unescape_role(F.substring(piece, F.lit(len(OPEN) + 1), colon - F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substring(piece, colon + 2, F.length(piece))).alias("text"),
        )

    return F.transform(turns, turn)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` per conversation.

    ``loss_spans`` lists (start from 0, length) in code points of every assistant body
    inside ``formatted``.  Rows of a conversation are ordered by turn, then role, then
    text, nulls first; repeated rows stay.  Null texts and roles are empty; rows without a
    conversation id form one conversation with a null id.  Each rendered conversation is
    parsed again and compared with its turns; a difference would be an error, not a wrong
    result.  A conversation is one training example and one row, as it is one string.
    Other columns are ignored; an empty table gives no row.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"head": F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(": ")), "body": render_body(F.col("text"))})
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(CLOSE)
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "head", "body", "start"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), F.length(t["body"]).cast("long").alias("length")))
    out = turns.select("conv_id", "turns", formatted.alias("formatted"), spans.alias("loss_spans"))
    same = parse(F.col("formatted")) == F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return out.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("conversation does not survive its round trip: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))).drop("turns")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations from their rendered text and loss spans alone."""
    turns = parse(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumns({"_turns": turns, "_loss": loss}).select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
