"""Chat transcripts from typed content parts.

A message is (conv_id, turn, role, parts); a part is (type, text, ref, width, height, seconds, pages). Every part is
visited once, in order: text is escaped, an image, audio or document part becomes one placeholder, its reference is
recorded with the token count that it will expand to. The template is

    <|turn|>role<|says|>content<|end|>   per turn, one after the other.

Control strings inside roles and texts are escaped: one backslash goes after the opening bracket, also if there are
some already, so that ``unescape`` restores any text and no control string of the template is left in it. Besides the
template's own ``<|`` the strings ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]`` are escaped, which other templates
act on.

One shuffle by conversation: turns are formatted row by row, their offsets are running sums over a window that spills,
and only the finished strings meet. A formatted conversation is one string by its nature.

Edge cases: null text and null role count as empty, null parts as no parts; a part of unknown or null type counts as
text; a missing size costs the type's least. Turns with one number go by role, then content; a null turn comes first.
Messages with a null conv_id form a conversation of their own. An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"

_BODY = r"\||/?s>|/?INST\]"
_CONTROL = rf"([<\[])(\\*)({_BODY})"
_ESCAPED = rf"([<\[])\\(\\*)({_BODY})"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

# Tokens that a placeholder expands to.
IMAGE_TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def text_part(text: Column) -> Column:
    """One text part as a list of parts."""
    fields = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"))]
    more = [F.lit(None).cast(t).alias(n) for n, t in (("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), *fields, *more))


def _tiles(pixels: Column) -> Column:
    return F.greatest(F.ceil(F.coalesce(pixels, F.lit(0)) / IMAGE_TILE), F.lit(1))


def expanded_tokens(part: Column) -> Column:
    """Tokens of a part's placeholder: image tiles, audio frames or pages; 0 for text."""
    audio = F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE), F.lit(1))
    pages = F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS
    image = _tiles(part["width"]) * _tiles(part["height"])
    kind = part["type"]
    tokens = F.when(kind == "image", image).when(kind == "audio", audio).when(kind == "document", pages)
    return F.coalesce(tokens, F.lit(0)).cast("bigint")


def is_media(part: Column) -> Column:
    return F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))


def visit(part: Column) -> Column:
    """What a part puts in its place."""
    placeholder = F.concat(F.lit("<|"), part["type"], F.lit("|>"))
    return F.when(is_media(part), placeholder).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def flatten(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content, attachments, expanded_tokens), one row per message."""
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    media = F.filter(parts, is_media)
    attachment = lambda p, i: F.struct(
        p["type"].alias("type"), i.alias("position"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")
    )
    return messages.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.concat_ws("", F.transform(parts, visit)).alias("content"),
        F.transform(media, attachment).alias("attachments"),
        F.aggregate(media, F.lit(0).cast("bigint"), lambda total, p: total + expanded_tokens(p)).alias("expanded_tokens"),
    )


def format_chat(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: formatted, n_turns, loss_spans, attachments, expanded_tokens.

    A loss span holds what the roles in ``learn`` say: start and end in code points of ``formatted``, and the same in
    bytes, which can be cut without walking the string. Attachments are in order, with the turn's place.
    """
    turns = flatten(messages)
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    turns = turns.withColumns({"head": head, "piece": F.concat(head, F.col("content"), F.lit(END))})
    order = ["turn", "role", "content"]
    # The conversation is the only shuffle key, for the window and for the grouping.
    one = Window.partitionBy("conv_id").orderBy(*order)
    before = one.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumns(
        {
            "at": F.row_number().over(one),
            "chars": F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"),
            "bytes": F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)) + F.octet_length("head"),
        }
    )
    span = F.struct(
        F.col("chars").alias("start"),
        (F.col("chars") + F.length("content")).alias("end"),
        F.col("bytes").alias("byte_start"),
        (F.col("bytes") + F.octet_length("content")).alias("byte_end"),
    )
    said = F.when(F.col("role").isin(*learn), span)
    media = F.transform("attachments", lambda a: F.struct(F.col("at").alias("message"), a["position"].alias("position"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    grouped = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(said)).alias("loss_spans"),
        F.array_sort(F.flatten(F.collect_list(media))).alias("attachments"),
        F.sum("expanded_tokens").alias("expanded_tokens"),
    )
    formatted = F.concat_ws("", F.col("pieces.piece"))
    return grouped.select("conv_id", formatted.alias("formatted"), "n_turns", "loss_spans", "attachments", "expanded_tokens")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as a list of (role, content), unescaped; placeholders stay in place."""
    cut = F.split(formatted, r"<\|turn\|>")
    pieces = F.slice(cut, F.lit(2), F.size(cut))
    pattern = r"(?s)^(.*?)<\|says\|>(.*)<\|end\|>$"
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, pattern, 1)).alias("role"), unescape(F.regexp_extract(p, pattern, 2)).alias("content")
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    raw = formatted.cast("binary")
    cut = lambda s: F.substring(raw, (s["byte_start"] + 1).cast("int"), (s["byte_end"] - s["byte_start"]).cast("int"))
    return F.transform(spans, lambda s: unescape(cut(s).cast("string")))
