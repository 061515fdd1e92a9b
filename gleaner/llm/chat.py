"""Chat formatting with typed content parts, with DataFrame functions only.

A turn's content is a list of parts: text, image, audio or document. Each kind has its own rule, and the rules are applied
to the parts in order: text is escaped, any other part becomes a placeholder, an attachment reference and a number of
tokens that a model will see in its place. A conversation becomes one string,

    <|turn|>role\nbody<|end|>\n    for each turn,

with the character spans of what the assistant said as its loss mask. Inside texts and roles the characters with which
control strings begin are escaped, so no text can be taken for one and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import word_count

TURN, END = "<|turn|>", "<|end|>\n"
#: A character and its escape; the ampersand first. Own control strings begin with "<", those of other templates with "<" or "[".
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
LINE = ("\n", "&#10;")
#: Tokens for a unit of an attachment: an image's tile, a second of audio, a page of a document.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def escape(text: Column, line: bool = False) -> Column:
    for plain, mark in (*ESCAPES, *([LINE] if line else [])):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    for plain, mark in (LINE, *reversed(ESCAPES)):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("units"))
    return F.array(part)


def _visit(part: Column) -> Column:
    """What a part becomes: its string in the body, its attachment and its tokens. An unknown or null kind counts as text."""
    text = F.coalesce(part["text"], F.lit(""))
    string, tokens = escape(text), word_count(text)
    for kind, each in UNIT_TOKENS.items():
        is_kind = part["kind"] == kind
        string = F.when(is_kind, F.lit(f"<|{kind}|>")).otherwise(string)
        tokens = F.when(is_kind, F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1)) * each).otherwise(tokens)
    attached = part["kind"].isin(*UNIT_TOKENS)
    ref = F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"))
    return F.struct(string.alias("string"), F.when(attached, ref).alias("attachment"), tokens.cast("bigint").alias("tokens"))


def flatten(parts: Column) -> Column:
    """struct(body, attachments in the order of their placeholders, tokens with placeholders expanded) of a turn's parts."""
    visited = F.transform(F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull()), _visit)
    body = F.array_join(F.transform(visited, lambda v: v["string"]), "")
    attachments = F.filter(F.transform(visited, lambda v: v["attachment"]), lambda a: a.isNotNull())
    tokens = F.aggregate(visited, F.lit(0).cast("bigint"), lambda n, v: n + v["tokens"])
    return F.struct(body.alias("body"), attachments.alias("attachments"), tokens.alias("tokens"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, parts): conv_id, formatted, loss_spans, attachments, tokens.

    ``loss_spans`` are (start, length) in code points, of the assistant's bodies in order. Turns are ordered by turn, null
    first; equal ones by role and body. Null roles and texts are empty, null parts are skipped, and a turn without parts has an
    empty body. Repeated rows are turns of their own. Null is a conversation like others. An empty table gives an empty
    result; other columns are not read. A conversation is one string and so must fit into memory; only that is gathered.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), flatten(F.col("parts")).alias("flat"))
    head = F.concat(F.lit(TURN), escape(F.col("role"), line=True), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", F.col("flat.body").alias("body"), "flat", head.alias("head"))
    rows = rows.withColumn("string", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    until = F.sum(F.length("string")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"no": F.row_number().over(order), "at": until - F.length("string")})
    start = (F.col("at") + F.length("head")).cast("bigint")
    turn = F.struct("no", "string", "role", start.alias("start"), F.length("body").cast("bigint").alias("length"), "flat")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    said = F.filter("turns", lambda t: t["role"] == "assistant")
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["string"]), "").alias("formatted"),
        F.transform(said, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["flat"]["attachments"])).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + t["flat"]["tokens"]).alias("tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order: array of struct(role, text, placeholders).

    ``text`` is what the text parts said, one after the other; ``placeholders`` are the kinds of the other parts, which
    belong to the attachments in order.
    """
    mark = r"<\|(" + "|".join(UNIT_TOKENS) + r")\|>"
    pieces = F.split(formatted, r"<\|turn\|>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END))
        text = unescape(F.regexp_replace(body, mark, ""))
        return F.struct(unescape(role).alias("role"), text.alias("text"), F.regexp_extract_all(body, F.lit(mark), F.lit(1)).alias("placeholders"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between; placeholders are not text."""
    mark = r"<\|(" + "|".join(UNIT_TOKENS) + r")\|>"
    cut = F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return unescape(F.regexp_replace(F.array_join(cut, ""), mark, ""))
