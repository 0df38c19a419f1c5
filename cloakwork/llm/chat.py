"""Conversations as training text, by relational means only.

The turn structs of a conversation are collected and sorted, adjacent turns of one
role become one run, and the pieces of all runs are concatenated.  Everything is a
Spark expression.

Template, for each run::

    <|im_start|>role
    text<|im_sep|>text<|im_end|>

`<|im_sep|>` stands between the turns that a run merges, so the turns can be read
back.  In texts and roles `<|` never stays: a backslash is put before the bar, and
one more where backslashes already stand between the two characters, which
`unescape` takes away again.  A line break in a role becomes `<|im_nl|>`.

Defined results: a null text or role is the empty string, a null conversation id is
an id of its own, turns sort by (turn, role, text) with null turns first, equal rows
stay as many turns, an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, NEW_LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|im_nl|>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _split(text: Column, mark: str) -> Column:
    return F.split(text, mark.replace("|", r"\|"))


def _piece(text: Column, learned: Column) -> Column:
    return F.struct(text.alias("text"), learned.alias("learned"))


def format_conversations(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learned_role: str = LEARNED_ROLE,
) -> DataFrame:
    """One row per conversation: id, `formatted` text and `mask`.

    `mask` is the loss mask in run lengths: structs (n_chars, in_loss) that cover
    `formatted` from its start to its end; `in_loss` marks texts of `learned_role`.
    """
    role_text = F.replace(escape(F.coalesce(F.col(role), F.lit(""))), F.lit("\n"), F.lit(NEW_LINE))
    struct = F.struct(
        F.col(turn).alias("turn"),
        role_text.alias("role"),
        escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )
    turns = df.select(F.col(conversation).alias("id"), struct.alias("turn")).groupBy("id")
    turns = turns.agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def begins_run(i: Column) -> Column:
        return (i == 0) | (F.get(F.col("turns"), i)["role"] != F.get(F.col("turns"), i - 1)["role"])

    n = F.size("turns")
    runs = turns.withColumn("starts", F.filter(F.sequence(F.lit(0), n - 1), begins_run)).withColumn(
        "runs",
        F.transform(
            "starts",
            lambda start, k: F.struct(
                F.get(F.col("turns"), start)["role"].alias("role"),
                F.slice(
                    F.col("turns")["text"], start + 1, F.coalesce(F.get(F.col("starts"), k + 1), n) - start
                ).alias("texts"),
            ),
        ),
    )
    no = F.lit(False)

    def run_pieces(run: Column) -> Column:
        learned = run["role"] == learned_role
        texts = F.transform(
            run["texts"],
            lambda t, j: F.when(j == 0, F.array(_piece(t, learned))).otherwise(
                F.array(_piece(F.lit(SEP), no), _piece(t, learned))
            ),
        )
        head = F.array(_piece(F.concat(F.lit(START), run["role"], F.lit("\n")), no))
        return F.concat(head, F.flatten(texts), F.array(_piece(F.lit(END), no)))

    pieces = runs.select("id", F.flatten(F.transform("runs", run_pieces)).alias("pieces"))
    return pieces.select(
        F.col("id").alias(conversation),
        F.array_join(F.col("pieces")["text"], "").alias("formatted"),
        F.transform(
            "pieces", lambda p: F.struct(F.length(p["text"]).alias("n_chars"), p["learned"].alias("in_loss"))
        ).alias("mask"),
    )


def read_back(df: DataFrame) -> DataFrame:
    """`turns` and `loss_text` from `formatted` and `mask`, all unescaped.

    Fails where a run of the mask does not have the length of its part of the text.
    """
    blocks = F.transform(
        F.filter(_split(F.col("formatted"), START), lambda _, i: i > 0),
        lambda b: F.struct(
            F.substring_index(b, "\n", 1).alias("role"),
            F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2).alias("body"),
        ),
    )
    inner = df.withColumn("blocks", blocks).withColumn(
        "blocks",
        F.transform(
            "blocks",
            lambda b: F.struct(
                b["role"].alias("role"),
                _split(F.substr(b["body"], F.lit(1), F.length(b["body"]) - len(END)), SEP).alias("texts"),
            ),
        ),
    )
    parts = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(F.concat(F.lit(START), b["role"], F.lit("\n"))),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, j: F.when(j == 0, F.array(t)).otherwise(F.array(F.lit(SEP), t)),
                    )
                ),
                F.array(F.lit(END)),
            ),
        )
    )

    def under_mask(part: Column, run: Column) -> Column:
        wrong = F.raise_error(F.lit("the mask does not fit the text")).cast("string")
        fits = F.length(part).eqNullSafe(run["n_chars"])
        return F.when(~fits, wrong).when(run["in_loss"], unescape(part)).otherwise("")

    return inner.withColumn(
        "turns",
        F.flatten(
            F.transform(
                "blocks",
                lambda b: F.transform(
                    b["texts"],
                    lambda t: F.struct(
                        unescape(F.replace(b["role"], F.lit(NEW_LINE), F.lit("\n"))).alias("role"),
                        unescape(t).alias("text"),
                    ),
                ),
            )
        ),
    ).withColumn("loss_text", F.array_join(F.zip_with(parts, "mask", under_mask), "")).drop("blocks")
