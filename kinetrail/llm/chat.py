"""Chat formatting of typed content parts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Control strings begin with < or [ and one of these tails; inside texts a backslash
#: goes between the two, after any backslashes that stand there already.
_TAIL = r"(\||/?s>|/?INST\])"
ESCAPE, UNESCAPE = r"([<\[])(\\*)" + _TAIL, r"([<\[])\\(\\*)" + _TAIL
#: Tokens that a placeholder stands for where a part doesn't say.
EXPANDED = {"image": 256, "audio": 128, "document": 512}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2$3"))


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one typed part."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"),
            none.cast("string").alias("ref"), none.cast("long").alias("tokens"),
        )
    )


#: While parts are joined, a control character opens a mark: a for itself in texts, b and c for a placeholder's ends.
_MARK = "\x01"


def _visit(part: Column) -> Column:
    """One part on its way into the body: its text, or its kind's placeholder, both in marks."""
    known = part["kind"].isin(*EXPANDED)
    text = F.replace(F.coalesce(part["text"], F.lit("")), F.lit(_MARK), F.lit(_MARK + "a"))
    return F.when(part["kind"] == "text", text).otherwise(
        F.concat(F.lit(_MARK + "b"), F.when(known, part["kind"]).otherwise("file"), F.lit(_MARK + "c"))
    )


def _body(parts: Column) -> Column:
    """All parts of a turn: texts that touch are escaped as one, so that no control string arises between them."""
    out = escape(F.array_join(F.transform(parts, _visit), ""))
    for mark, meant in (("b", "<|"), ("c", "|>"), ("a", _MARK)):
        out = F.replace(out, F.lit(_MARK + mark), F.lit(meant))
    return out


def _attachment(part: Column) -> Column:
    default = F.lit(0).cast("long")
    for kind, n in EXPANDED.items():
        default = F.when(part["kind"] == kind, F.lit(n).cast("long")).otherwise(default)
    return F.struct(
        part["kind"].alias("kind"), part["ref"].alias("ref"),
        F.coalesce(part["tokens"], default).alias("tokens"),
    )


def format_chat(
    messages: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    loss_role: str = "assistant",
) -> DataFrame:
    """One formatted text per conversation, with its loss mask and attachments.

    `parts_col` is an array of struct<kind, text, ref, tokens>. Text parts are
    escaped, neighbours as one text, and other parts become ordered placeholders `<|kind|>` (`<|file|>` for
    unknown or null kinds). A turn is `<s>role\\nbody</s>`; control strings inside texts and
    roles are escaped reversibly (see read_turns). Message offsets come from a
    running sum per conversation, so nothing is quadratic in the turns; a
    conversation's own text is the one thing that meets in a row.

    Returns id_col, n_turns (long), formatted (string), loss_spans (array of
    start, end in code points, end exclusive), attachments (array of turn, part,
    kind, ref, tokens in order), expanded_tokens (long). A null list of parts or a null text is empty, a null
    part in a list doesn't count, a null role is an empty one, null turns come first, ties go by role and parts,
    repeated rows are turns of their own, and null ids form one conversation. Empty
    table: no rows. Other columns are ignored.
    """
    rows = messages.select(
        F.col(id_col).alias("_kt_id"), F.col(turn_col).alias("_kt_turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("_kt_role"),
        F.filter(F.coalesce(F.col(parts_col), F.array().cast(messages.schema[parts_col].dataType)), lambda p: p.isNotNull()).alias("_kt_parts"),
    )
    order = Window.partitionBy("_kt_id").orderBy("_kt_turn", "_kt_role", "_kt_parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = (
        rows.withColumn("_kt_head", F.concat(F.lit("<s>"), escape_role(F.col("_kt_role")), F.lit("\n")))
        .withColumn("_kt_body", _body(F.col("_kt_parts")))
        .withColumn("_kt_out", F.concat("_kt_head", "_kt_body", F.lit("</s>")))
        .withColumn("_kt_n", F.row_number().over(order))
        .withColumn("_kt_start", F.coalesce(F.sum(F.length("_kt_out")).over(before), F.lit(0)) + F.length("_kt_head"))
        .withColumn(
            "_kt_files",
            F.filter(
                F.transform(
                    "_kt_parts",
                    lambda p, i: F.struct(
                        F.col("_kt_n").alias("turn"), (i + 1).alias("part"), _attachment(p).alias("what")
                    ),
                ),
                lambda x: ~x["what"]["kind"].eqNullSafe(F.lit("text")),
            ),
        )
    )
    every = turns.groupBy("_kt_id").agg(
        F.count("*").alias("n_turns"),
        F.sort_array(
            F.collect_list(
                F.struct(
                    "_kt_n", "_kt_out", "_kt_start", F.length("_kt_body").alias("len"),
                    (F.col("_kt_role") == loss_role).alias("loss"), "_kt_files",
                )
            )
        ).alias("t"),
    )
    flat = F.transform(
        F.flatten(F.col("t._kt_files")),
        lambda a: F.struct(
            a["turn"].alias("turn"), a["part"].alias("part"), a["what"]["kind"].alias("kind"),
            a["what"]["ref"].alias("ref"), a["what"]["tokens"].alias("tokens"),
        ),
    )
    return every.select(
        F.col("_kt_id").alias(id_col),
        "n_turns",
        F.array_join(F.col("t._kt_out"), "").alias("formatted"),
        F.transform(
            F.filter("t", lambda x: x["loss"]),
            lambda x: F.struct(x["_kt_start"].alias("start"), (x["_kt_start"] + x["len"]).alias("end")),
        ).alias("loss_spans"),
        flat.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of struct<role, text>, texts unescaped."""
    pieces = F.filter(F.split(formatted, "</s>", -1), lambda x: x != "")
    body = F.transform(pieces, lambda x: F.substr(x, F.lit(4)))
    return F.transform(
        body,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substr(x, F.position(F.lit("\n"), x) + 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations and one with control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"),
    )
    out = format_chat(rows.unionByName(more).withColumn("parts", text_parts(F.col("text"))))
    back = out.withColumn("turns", read_turns(F.col("formatted"))).withColumn(
        "loss", read_loss(F.col("formatted"), F.col("loss_spans"))
    )
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, 8 + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g'))
            + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS n
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
