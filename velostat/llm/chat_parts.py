"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is a list of parts.  A visitor flattens them in order:
text is escaped, an image, audio or document part becomes a placeholder, and
its reference and expanded token count are recorded.  A turn is

    <turn>role\\n content </turn>

without the spaces.  ``&`` and ``<`` in texts become ``&amp;`` and ``&lt;``
(in roles also a newline becomes ``&#10;``), so a formatted text has no ``<``
but the template's, and :func:`read_back` undoes it.  The loss mask is the
(start, length) in code points of each assistant content.

Rows go by turn (null first); rows of the same turn by role, then content, both
as they are written out, that is escaped.  A null text or role counts as empty,
null parts as none.  Repeated rows are turns of their own.  Rows with a null
``conv_id`` are one conversation.  An empty table gives an empty one.  Further
columns of the input are not read.  A conversation's text is put together in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Expanded tokens: an image's tiles, a second of audio, a document's page.
TILE, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 28, 1, 25, 600


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """A text as the only part of a content."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none("string").alias("ref"),
            none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages"),
        )
    )


def part_text(part: Column) -> Column:
    """What a part becomes: escaped text, or a placeholder by its type."""
    own = F.coalesce(part["text"], F.lit(""))
    return F.when(F.coalesce(part["type"], F.lit("text")) == "text", escaped(own)).otherwise(
        F.concat(F.lit("<"), F.regexp_replace(part["type"], "[^a-z0-9_]", "_"), F.lit("/>"))
    )


def part_tokens(part: Column) -> Column:
    """Tokens that a placeholder stands for."""
    tiles = lambda size: F.ceil(F.coalesce(size, F.lit(0)) / TILE)
    kind = part["type"]
    return (
        F.when(kind == "image", tiles(part["width"]) * tiles(part["height"]) * TILE_TOKENS)
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * SECOND_TOKENS))
        .when(kind == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def format_chats(messages: DataFrame) -> DataFrame:
    """Per conversation of ``messages(conv_id, turn, role, parts)``: the
    formatted text, the loss mask, the attachments in the order of their
    placeholders, and the sum of their tokens.

    One shuffle by conversation: the running length (for the mask) and the
    lists use the same partitioning and order."""
    parts = F.coalesce("parts", F.expr(f"CAST(array() AS array<{PART}>)"))
    files = F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")) != "text")
    turns = messages.select(
        "conv_id",
        "turn",
        F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&#10;")).alias("role"),
        F.array_join(F.transform(parts, part_text), "").alias("content"),
        F.transform(
            files, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))
        ).alias("files"),
    )
    turns = turns.withColumn("piece", F.concat(F.lit(OPEN), "role", F.lit("\n"), "content", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("n", F.row_number().over(order)).withColumn(
        "at", F.coalesce(F.sum(F.char_length("piece").cast("long")).over(before), F.lit(0))
    )
    loss = F.struct(
        (F.col("at") + len(OPEN) + F.char_length("role") + 1).alias("start"), F.char_length("content").cast("long").alias("length")
    )
    listed = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "piece", "files", F.when(F.col("role") == "assistant", loss).alias("loss")))).alias("turns")
    )
    return listed.select(
        "conv_id",
        F.array_join("turns.piece", "").alias("formatted"),
        F.filter("turns.loss", lambda x: x.isNotNull()).alias("loss_mask"),
        F.flatten("turns.files").alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments.tokens", F.lit(0).cast("long"), lambda a, b: a + b))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    pieces = F.filter(F.split(formatted, OPEN), lambda x: x != "")

    def turn(piece: Column) -> Column:
        body = F.left(piece, F.char_length(piece) - len(CLOSE))
        cut = F.instr(body, "\n")
        role = F.replace(F.left(body, cut - 1), F.lit("&#10;"), F.lit("\n"))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(body, cut + 1)).alias("text"))

    return F.transform(pieces, turn)


def under_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    cut = F.transform(mask, lambda x: unescaped(F.substr(formatted, (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return F.array_join(cut, "")
