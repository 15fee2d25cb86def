r"""Chat formatting over typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) into one string: texts
are escaped, every other part becomes an ordered placeholder, its reference and the number of
tokens it expands to are recorded. Turns become ``<turn role="...">body</turn>\n``.

Escaping maps ``\`` to ``\b``, ``<`` to ``\l`` and ``"`` to ``\q``. After it a text holds no
``<`` and no ``"``, so no text can look like a mark, and every ``\`` is followed by its code,
so undoing ``\l`` and ``\q`` before ``\b`` restores each text exactly.

Defined results: a null text, role or part list is empty; a null turn sorts first; turns with
the same number are ordered by role, then body; an empty table gives no rows; extra columns are
ignored. A part of an unknown kind gets a placeholder of its kind with no tokens. One
conversation is one output string, so its rows meet in one task; all work on texts is done
before that shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = '<turn role="', '">', "</turn>\n"
PART_TYPE = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Pixels on a side of an image patch, audio tokens a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 256


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ('"', "\\q")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("<", "\\l"), ('"', "\\q"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """One text part."""
    nothing = [F.lit(None).cast(t) for t in ("string", "int", "int", "double", "int")]
    names = ("ref", "width", "height", "seconds", "pages")
    return F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *(c.alias(n) for c, n in zip(nothing, names))
    )


def part_tokens(part: Column) -> Column:
    """The tokens that a part other than text expands to."""
    side = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / PATCH)
    return (
        F.when(part["kind"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def visit(parts: Column) -> tuple[Column, Column]:
    """The body of a turn, and its attachments (kind, ref, tokens) in placeholder order."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>"))

    def one(part: Column, at: Column) -> Column:
        nth = F.size(F.filter(F.slice(parts, 1, at + 1), lambda p: ~_is_text(p))) - 1
        mark = F.concat(F.lit("<"), escape(part["kind"]), F.lit(" "), nth.cast("string"), F.lit(' tokens="'), part_tokens(part).cast("string"), F.lit('"/>'))
        return F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)

    body = F.array_join(F.transform(parts, one), "")
    attached = F.transform(
        F.filter(parts, lambda p: ~_is_text(p)),
        lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")),
    )
    return body, attached


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, parts`` to ``conv_id, formatted, attachments``, one row a conversation."""
    body, attached = visit(F.col("parts"))
    line = F.concat(F.lit(OPEN), escape(F.coalesce(F.col("role"), F.lit(""))), F.lit(MIDDLE), body, F.lit(CLOSE))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), line.alias("line"), attached.alias("attached"))
    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "line", "attached"))).alias("lines"))
        .select(
            "conv_id",
            F.array_join(F.col("lines.line"), "").alias("formatted"),
            F.flatten(F.col("lines.attached")).alias("attachments"),
        )
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``, placeholders left out."""

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, MIDDLE, 1)
        body = F.substr(piece, F.length(head) + len(MIDDLE) + 1)
        text = unescape(F.regexp_replace(body, r'<[^<>"]* \d+ tokens="\d+"/>', ""))
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), text.alias("text"))

    pieces = F.split(formatted, CLOSE, -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def digest(formatted: DataFrame) -> DataFrame:
    """What a trainer reads from the formatted string: turns and the text under the loss mask."""
    turns = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
