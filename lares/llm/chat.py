"""Chat formatting checked by a grammar round trip (operator 9). DataFrame functions only.

Grammar of a formatted conversation: turns, one after another, each one of

    assistant:   [ANS]text</s>            (trained on: the loss mask covers the text)
    user:        [INST]text[/INST]
    other role:  [ROLE]role, line break, text[/ROLE]

A text is written as it is. The result is parsed by one left-to-right pattern, which also undoes
escapes (a backslash before any character), and compared with the source turns. A conversation
that does not come back is written again with the conflicting texts escaped (a backslash before
every backslash and every bracket that could open or close a control string), parsed and
compared again; if a text was right alone but not beside its neighbours, all texts are escaped.
The last step always comes back, because an escaped text holds no control string.

Defined results: rows of a conversation are ordered by turn, role, text (nulls first); null text
and null role are empty; repeated rows are repeated turns; a null conv_id is a conversation of
its own; an empty table gives only what the caller adds. One conversation is one output string,
so its turns meet in one row by definition; nothing larger does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANS, INST, END_INST, ROLE, END_ROLE, END = "[ANS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "</s>"
#: One turn of the grammar. Groups: assistant text, user text, other role, its text.
TURN = r"(?s)\[ANS\](.*?)</s>|\[INST\](.*?)\[/INST\]|\[ROLE\](.*?)\n(.*?)\[/ROLE\]"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\]<>])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _write(role: Column, text: Column) -> Column:
    # an escaped role holds no bare bracket, so "[n]" can stand for a line break
    safe_role = F.replace(escape(role), F.lit("\n"), F.lit("[n]"))
    return (F.when(role == "assistant", F.concat(F.lit(ANS), text, F.lit(END)))
            .when(role == "user", F.concat(F.lit(INST), text, F.lit(END_INST)))
            .otherwise(F.concat(F.lit(ROLE), safe_role, F.lit("\n"), text, F.lit(END_ROLE))))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: _write(t.role, t.text)), "")


def _parsed_turn(piece: Column) -> Column:
    """role and text of one piece that matches the grammar."""
    body = lambda a, z: F.substring(piece, F.lit(len(a) + 1), F.length(piece) - len(a) - len(z))
    other = body(ROLE, END_ROLE)
    line = F.locate("\n", other)
    return (F.when(piece.startswith(ANS), F.struct(F.lit("assistant").alias("role"), unescape(body(ANS, END)).alias("text")))
            .when(piece.startswith(INST), F.struct(F.lit("user").alias("role"), unescape(body(INST, END_INST)).alias("text")))
            .otherwise(F.struct(unescape(F.replace(F.substring(other, F.lit(1), line - 1), F.lit("[n]"), F.lit("\n"))).alias("role"),
                                unescape(F.substring(other, line + 1, F.length(other))).alias("text"))))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation; null where some of it is outside the grammar."""
    pieces = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    whole = F.length(F.array_join(pieces, "")) == F.length(formatted)
    return F.when(whole, F.transform(pieces, _parsed_turn))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (source), formatted, recovered: the last two agree with the first for every row."""
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_sorted"))
    turns = F.transform("_sorted", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).cast(TURNS)
    plain = grouped.select("conv_id", turns.alias("turns")).select("conv_id", "turns", render(F.col("turns")).alias("_0"))
    checked = plain.select("conv_id", "turns", F.when(F.equal_null(parse(F.col("_0")).cast(TURNS), F.col("turns")), F.col("_0")).alias("_0"))
    # conflicting texts only: those that do not come back when written alone
    alone = lambda t: F.equal_null(parse(_write(t.role, t.text)).cast(TURNS), F.array(t).cast(TURNS))
    some = render(F.transform("turns", lambda t: F.struct(t.role.alias("role"), F.when(alone(t), t.text).otherwise(escape(t.text)).alias("text"))))
    every = render(F.transform("turns", lambda t: F.struct(t.role.alias("role"), escape(t.text).alias("text"))))
    second = checked.select("conv_id", "turns", "_0", F.when(F.col("_0").isNull(), some).alias("_1"))
    third = second.select("conv_id", "turns", F.coalesce("_0", F.when(F.equal_null(parse(F.col("_1")).cast(TURNS), F.col("turns")), F.col("_1")), every).alias("formatted"))
    return third.select("conv_id", "turns", "formatted", parse(F.col("formatted")).cast(TURNS).alias("recovered"))


def verified(table: DataFrame) -> DataFrame:
    """The same rows; fails loudly if a conversation did not come back."""
    same = F.equal_null("recovered", F.col("turns"))
    return table.withColumn("recovered", F.when(same, F.col("recovered")).otherwise(F.raise_error(F.lit("a formatted conversation does not parse back"))))


def digest(table: DataFrame) -> DataFrame:
    """What is read back from the formatted text: turns, the text under the loss mask, sizes."""
    loss = F.array_join(F.transform(F.filter("recovered", lambda t: t.role == "assistant"), lambda t: t.text), "")
    told = F.array_join(F.transform("recovered", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return table.select("conv_id", F.size("recovered").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def conflicting(spark) -> DataFrame:
    """Conversation -7: texts that look like the template's own marks."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
