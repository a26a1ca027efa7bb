"""Chat formatting of typed content parts, in DataFrame functions only.

A turn's content is an ordered list of parts: text, image, audio or document. Visiting them gives the escaped text of
text parts and a numbered placeholder for every other part, and records what each placeholder stands for and how many
tokens it expands to. The template is ``<|turn|>role<|text|>content<|end|>``; every control string starts with ``<|``,
which can't occur in escaped text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ATTACHMENT_KINDS = ("image", "audio", "document")
PART_TYPE = "struct<type: string, text: string, ref: string, tokens: int>"
#: Tokens of an attachment that does not say its own.
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}


def escape(text: Column) -> Column:
    """Backslashes are doubled, then ``<|`` gets one between its characters."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def visit(parts: Column, default_tokens: dict[str, int] | None = None) -> Column:
    """Each part as ``piece`` (formatted) with ``kind``, ``ref`` and ``tokens`` of an attachment.

    Unknown types are text, as are null types; a null text is empty.
    """
    defaults = default_tokens or DEFAULT_TOKENS

    def one(part: Column, at: Column) -> Column:
        kind = F.lower(part["type"])
        tokens = F.coalesce(part["tokens"], *[F.when(kind == k, F.lit(n)) for k, n in defaults.items()])
        return F.when(
            F.coalesce(kind.isin(*ATTACHMENT_KINDS), F.lit(False)),
            F.struct(
                F.concat(F.lit("<|"), kind, F.lit(":"), at.cast("string"), F.lit("|>")).alias("piece"),
                kind.alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"),
            ),
        ).otherwise(
            F.struct(
                escape(F.coalesce(part["text"], F.lit(""))).alias("piece"), F.lit(None).cast("string").alias("kind"),
                F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"),
            )
        )

    return F.transform(parts, one)


def text_parts(text: Column) -> Column:
    """Plain text as the only part of its turn; null is empty."""
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"),
    )
    return F.array(part.cast(PART_TYPE))


def format_conversations(
    turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), default_tokens: dict[str, int] | None = None
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``n_turns``, ``formatted``, ``loss_spans`` (``start`` and ``length`` in
    characters), ``attachments`` (``turn``, ``part``, ``kind``, ``ref``, ``tokens``) and ``attachment_tokens``.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``parts`` (an array of ``type``, ``text``, ``ref``, ``tokens``);
    other columns are left out. Turns are ordered by ``turn``, nulls first, ties by role and content; repeated rows are
    repeated turns. Null roles, parts and texts are empty; a null conversation id is a conversation of its own.
    A conversation is one result row, so its turns meet in one task; conversations are spread by id.
    """
    seen = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        visit(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART_TYPE}>")), default_tokens).alias("seen"),
    )
    pieces = seen.select(
        "conv_id", "turn", "role",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"),
        F.array_join(F.transform("seen", lambda p: p["piece"]), "").alias("body"),
        F.filter(
            F.transform("seen", lambda p, i: F.struct(
                F.col("turn").alias("turn"), i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")
            )), lambda a: a["kind"].isNotNull(),
        ).alias("attached"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    size = F.length("head") + F.length("body") + len(END)
    placed = pieces.withColumn("at", F.row_number().over(order)).withColumn(
        "start", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    row = F.struct(
        "at", F.concat("head", "body", F.lit(END)).alias("piece"), F.col("role").isin(*loss_roles).alias("in_loss"),
        (F.col("start") + F.length("head")).alias("start"), F.length("body").alias("length"), "attached",
    )
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    attachments = F.flatten(F.transform("rows", lambda r: r["attached"]))
    return rows.select(
        "conv_id", F.size("rows").cast("long").alias("n_turns"),
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("rows", lambda r: r["in_loss"]), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"))
        ).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + F.coalesce(a["tokens"], F.lit(0))).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns behind a formatted conversation: an array of ``role`` and ``text``, unescaped."""
    pieces = F.split(formatted, r"<\|end\|>")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(TURN) + 1, 2**31 - 1), TEXT, 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, TEXT) + len(TEXT), F.length(p))).alias("text"),
    ))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"]))), ""
    )
