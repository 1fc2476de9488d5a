"""Chat formatting: conversations of typed content parts to one training text.

Each turn has an array of parts (text, image, audio, document).  A visitor folds
over the parts of a turn and flattens them into the turn's body: text is escaped,
every other part becomes a numbered placeholder ``<image:3>``, its reference is
recorded, and the tokens it will expand to are added up.  Turns are rendered as
``<turn:ROLE>BODY</turn>`` plus a newline, in turn order; the loss mask is one
span of code points per turn of the loss role.

Texts and roles escape the template's control characters reversibly
(``\\`` to ``\\s``, ``<`` to ``\\l``, ``>`` to ``\\g``), so no text can imitate a
mark or a placeholder, and ``read_back`` splits the formatted text exactly.

Plan: one exchange on the conversation id serves the running sums (window) and
the grouping.  A conversation is one output value, so its turns do meet in one
task; nothing else does.

Defined cases: null text or null parts array: empty body; null role: empty role;
null turn: first; turns with equal number: by role, then body, repeated rows all
kept; null conversation id: one conversation of its own; unknown part type: a
``<part:N>`` placeholder of no tokens; empty table: no rows.  Extra columns of the
input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TYPE = (
    "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
)
END = "</turn>\n"


@dataclass(frozen=True)
class TokenRates:
    """How many tokens a part expands to."""

    image_tile: int = 512  # pixels a side
    tokens_per_tile: int = 170
    image_base: int = 85
    audio_per_second: float = 25.0
    tokens_per_page: int = 600


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\s"))
    c = F.replace(c, F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\g"), F.lit(">"))
    c = F.replace(c, F.lit("\\l"), F.lit("<"))
    return F.replace(c, F.lit("\\s"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """The parts array of a plain text."""
    null = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"),
            null.cast("int").alias("width"), null.cast("int").alias("height"),
            null.cast("double").alias("seconds"), null.cast("int").alias("pages"),
        )
    ).cast(PART_TYPE)


def _tokens(p: Column, rates: TokenRates) -> Column:
    tiles = lambda side: F.ceil(F.coalesce(side, F.lit(0)) / F.lit(rates.image_tile))
    spaces = F.size(F.split(F.btrim(F.coalesce(p["text"], F.lit(""))), r"\s+"))
    return (
        F.when(p["type"] == "text", F.when(F.btrim(F.coalesce(p["text"], F.lit(""))) == "", 0).otherwise(spaces))
        .when(p["type"] == "image", F.lit(rates.image_base) + tiles(p["width"]) * tiles(p["height"]) * rates.tokens_per_tile)
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * rates.audio_per_second))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * rates.tokens_per_page)
        .otherwise(0)
        .cast("long")
    )


def _is_text(p: Column) -> Column:
    return F.coalesce(p["type"] == "text", F.lit(False))


def _visit(parts: Column, before: Column, rates: TokenRates) -> Column:
    """Fold over the parts: body so far, attachments so far, tokens so far."""
    kind = lambda p: F.when(p["type"].isin("image", "audio", "document"), p["type"]).otherwise("part")
    start = F.struct(
        F.lit("").alias("body"),
        F.array().cast("array<struct<ordinal:bigint,type:string,ref:string,tokens:bigint>>").alias("refs"),
        F.lit(0).cast("long").alias("tokens"),
    )

    def step(a: Column, p: Column) -> Column:
        ordinal = before + F.size(a["refs"]) + 1
        place = F.concat(F.lit("<"), kind(p), F.lit(":"), ordinal.cast("string"), F.lit(">"))
        ref = F.struct(
            ordinal.cast("long").alias("ordinal"), kind(p).alias("type"), p["ref"].alias("ref"),
            _tokens(p, rates).alias("tokens"),
        )
        return F.struct(
            F.concat(a["body"], F.when(_is_text(p), escape(p["text"])).otherwise(place)).alias("body"),
            F.when(_is_text(p), a["refs"]).otherwise(F.concat(a["refs"], F.array(ref))).alias("refs"),
            (a["tokens"] + _tokens(p, rates)).alias("tokens"),
        )

    return F.aggregate(parts, start, step)


def format_chat(turns: DataFrame, loss_role: str = "assistant", rates: TokenRates = TokenRates()) -> DataFrame:
    """One row per conversation from ``(conv_id, turn, role, parts)``.

    Returns conv_id, formatted, formatted_chars, turns (start, end, loss_start,
    loss_end in code points of ``formatted``; no loss span: nulls), attachments
    (ordinal, type, ref, tokens, turn_index), n_tokens.
    """
    none = F.array().cast(PART_TYPE)
    base = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", none).alias("parts"))
    base = base.withColumn("n_refs", F.size(F.filter("parts", lambda p: ~_is_text(p))))
    # equal turn numbers: by role and text, so that repeated runs agree
    tie = F.to_json("parts")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", tie)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("seq", F.row_number().over(order)).withColumn(
        "before", F.coalesce(F.sum("n_refs").over(ahead), F.lit(0))
    )
    base = base.withColumn("v", _visit(F.col("parts"), F.col("before"), rates))
    head = F.concat(F.lit("<turn:"), escape(F.col("role")), F.lit(">"))
    base = base.select(
        "conv_id", "seq", (F.col("role") == loss_role).alias("is_loss"), head.alias("head"), "v",
        F.length(head).alias("head_len"), F.length(F.col("v.body")).alias("body_len"),
    ).withColumn("len", (F.col("head_len") + F.col("body_len") + F.lit(len(END))).cast("long"))
    rows = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("start", F.coalesce(F.sum("len").over(rows), F.lit(0)))
    one = F.struct(
        "seq", F.concat("head", "v.body", F.lit(END)).alias("text"), "start", "len", "is_loss", "head_len", "body_len",
        F.col("v.refs").alias("refs"), F.col("v.tokens").alias("tokens"),
    )
    got = base.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))

    def span(t: Column) -> Column:
        body = t["start"] + t["head_len"]
        return F.struct(
            t["start"].alias("start"), (t["start"] + t["len"]).alias("end"),
            F.when(t["is_loss"], body).alias("loss_start"), F.when(t["is_loss"], body + t["body_len"]).alias("loss_end"),
        )

    refs = F.flatten(
        F.transform("t", lambda t: F.transform(t["refs"], lambda r: F.struct(
            r["ordinal"].alias("ordinal"), r["type"].alias("type"), r["ref"].alias("ref"), r["tokens"].alias("tokens"),
            (t["seq"] - 1).alias("turn_index"))))
    )
    return got.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["text"]), "").alias("formatted"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + t["len"]).alias("formatted_chars"),
        F.transform("t", span).alias("turns"),
        refs.alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` plus what its own text says: ``read_turns`` (role, text) by
    splitting at the turn marks, ``read_loss`` (unescaped text under each span of the
    loss mask, in order).  Bodies keep the placeholders of attachments."""
    blocks = F.split("formatted", END)
    df = formatted.withColumn("blocks", F.slice(blocks, 1, F.size("turns")))

    def turn(b: Column) -> Column:
        head = F.substring_index(b, ">", 1)
        return F.struct(
            unescape(F.substr(head, F.lit(len("<turn:") + 1))).alias("role"),
            unescape(F.substr(b, F.length(head) + 2)).alias("text"),
        )

    under = F.zip_with(
        "blocks", "turns",
        lambda b, t: F.substr(
            b, (t["loss_start"] - t["start"] + 1).cast("int"), (t["loss_end"] - t["loss_start"]).cast("int")
        ),
    )
    return df.select(
        *formatted.columns,
        F.transform("blocks", turn).alias("read_turns"),
        F.transform(F.filter(under, lambda x: x.isNotNull()), unescape).alias("read_loss"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, all read back from the formatted text."""
    loss = F.array_join("read_loss", "")
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_tokens",
        F.size("attachments").cast("long").alias("n_attachments"),
    )
