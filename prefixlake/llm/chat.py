"""Chat formatting of typed content parts, with a loss mask and reversible escapes.

A turn is a role and an ordered list of parts: text, image, audio or document. A visitor turns
each part into text: a text part is itself, escaped; any other becomes a placeholder that
counts it, and leaves an attachment record with its reference and the tokens it stands for.
A turn is written as ``<|im_start|>role``, a line break, the parts, ``<|im_end|>`` and a line
break. Text that looks like a control string gets one backslash after its ``<``; texts that
already look so get one more, so reading removes exactly one and every text comes back.

A conversation is one output row and so is gathered in one task; a third of all rows may be
equal conversations, which are different rows, but one conversation must fit in memory.
Turns are ordered by turn, null first, then role and text, so ties and repeated rows have one
result. A null role or text is empty, a null conversation id is a conversation of its own,
null parts are none, a part of unknown type is a document. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"  # fixed values of the template
LOSS_ROLES = ("assistant",)
PATCH, MERGE = 14, 2  # an image counts one token per square of PATCH * MERGE pixels
AUDIO_TOKENS_PER_SECOND = 25
TOKENS_PER_PAGE = 256

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    plain = F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25"))
    return escape(F.replace(plain, F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_part(text: Column) -> Column:
    """A one-part list for plain messages."""
    empty = [F.lit(None).cast(t).alias(n) for n, t in (
        ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *empty)).cast(PARTS)


def expanded_tokens(part: Column) -> Column:
    """Tokens that a placeholder stands for once an encoder has replaced it; 0 for text."""
    side = PATCH * MERGE
    squares = F.ceil(F.coalesce(part["width"], F.lit(0)) / side) * F.ceil(F.coalesce(part["height"], F.lit(0)) / side)
    return (
        F.when(part["type"] == "text", F.lit(0))
        .when(part["type"] == "image", squares)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND))
        .otherwise(F.coalesce(part["pages"], F.lit(0)) * TOKENS_PER_PAGE)
        .cast("long")
    )


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin("text", "image", "audio"), part["type"]).otherwise(F.lit("document"))


def _visit(parts: Column) -> Column:
    """The text of the parts, placeholders numbered by their place in the message."""
    return F.array_join(
        F.transform(parts, lambda part, k: F.when(_kind(part) == "text", escape(part["text"])).otherwise(
            F.concat(F.lit("<|"), _kind(part), F.lit(":"), k.cast("string"), F.lit("|>")))), "")


def _attachments(turn: Column) -> Column:
    found = F.transform(turn["parts"], lambda part, k: F.struct(
        turn["turn"].alias("turn"), k.cast("int").alias("part"), _kind(part).alias("type"), part["ref"].alias("ref"),
        expanded_tokens(F.struct(_kind(part).alias("type"), *[part[n].alias(n) for n in ("width", "height", "seconds", "pages")]))
        .alias("tokens")))
    return F.filter(found, lambda a: a["type"] != "text")


def format_chats(
    messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    parts_col: str = "parts", loss_roles: tuple[str, ...] = LOSS_ROLES,
) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments, expanded_tokens: one row per conversation.

    ``loss_spans`` are start and length, in code points of ``formatted``, of the content of every
    turn whose role takes part in the loss; ``attachments`` are in order of turn and part.
    """
    turn = F.struct(
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(parts_col), F.array().cast(PARTS)).alias("parts"))
    grouped = messages.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"),
        _visit(t["parts"]).alias("body"), t["role"].isin(*loss_roles).alias("loss")))
    sized = F.transform("pieces", lambda p: F.struct(
        F.char_length(p["head"]).cast("long").alias("head"), F.char_length(p["body"]).cast("long").alias("body"),
        p["loss"].alias("loss")))
    tail = len(END) + 1
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    spans = F.aggregate(
        "sized", start,
        lambda done, p: F.struct(
            (done["at"] + p["head"] + p["body"] + tail).alias("at"),
            F.when(p["loss"], F.concat(done["spans"], F.array(F.struct(
                (done["at"] + p["head"]).alias("start"), p["body"].alias("length")))))
            .otherwise(done["spans"]).alias("spans")),
        lambda done: done["spans"])
    return (
        grouped.withColumn("pieces", pieces)
        .withColumn("sized", sized)
        .select(
            "conv_id",
            F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "").alias("formatted"),
            spans.alias("loss_spans"),
            F.flatten(F.transform("turns", _attachments)).alias("attachments"))
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as structs of role and text, escapes removed."""
    marked = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(marked, 1, F.size(marked) - 1)
    return F.transform(turns, lambda t: F.struct(
        _unescape_role(F.substring_index(F.substr(t, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(t, F.instr(t, "\n") + 1)).alias("text")))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, escapes removed, nothing between the spans."""
    return F.array_join(F.transform(
        spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
