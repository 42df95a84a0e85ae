"""Chat formatting with Spark expressions: one text per conversation, with the loss mask and the way back.

Template: ``<s>`` then every run of adjacent turns of one role as

    [INST]text[/INST]          user
    [OUT]text</s>              assistant, the text is under the loss mask
    [ROLE]role[TURN]text[/ROLE]  any other role

Further turns of the same run follow after ``[TURN]``. Inside texts and role names a backslash is doubled and a control
string gets a backslash after its first character, so a control string in the output is always the template's own, and
dropping those backslashes gives the text back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sha256_of

#: Fixed control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[TURN]")
_PATTERN = "|".join("(?<={})(?={})".format(*(c.replace("[", r"\[").replace("]", r"\]") for c in (s[0], s[1:])))
                    for s in CONTROLS)
_RUNS = r"(?s)\[INST\].*?\[/INST\]|\[OUT\].*?</s>|\[ROLE\].*?\[/ROLE\]"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _PATTERN, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _marks(role: Column) -> tuple[Column, Column]:
    opening = (F.when(role == "user", F.lit("[INST]")).when(role == "assistant", F.lit("[OUT]"))
               .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[TURN]"))))
    closing = F.when(role == "user", F.lit("[/INST]")).when(role == "assistant", F.lit("</s>")).otherwise(F.lit("[/ROLE]"))
    return opening, closing


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): ``loss`` lists [start, end) in code points, one entry per assistant turn.

    Turns are ordered by ``turn`` (null first), then role and text, so that ties and repeated rows have one order;
    repeated rows are all kept. Null texts and roles count as empty; rows with a null conv_id form one conversation.
    A conversation is one training example and so one row of the result. It is put together with map-side partial
    aggregation, and its size is that of the example. An empty table gives an empty one.
    """
    turns = conversations.select(
        "conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    empty_run = "cast(array() as array<struct<role:string,texts:array<string>>>)"
    # Merge adjacent turns of one role: either the last run gets another text, or a new run starts.
    runs = F.aggregate(
        "turns", F.expr(empty_run),
        lambda acc, t: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["role"] == t["role"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                t["role"].alias("role"), F.concat(F.element_at(acc, -1)["texts"], F.array(escape(t["text"]))).alias("texts")))))
        .otherwise(F.concat(acc, F.array(F.struct(t["role"].alias("role"), F.array(escape(t["text"])).alias("texts"))))))
    merged = grouped.select("conv_id", runs.alias("runs"))

    def pieces(run: Column) -> Column:
        opening, closing = _marks(run["role"])
        marked = F.transform(run["texts"], lambda x, i: F.struct(
            F.when(i == 0, opening).otherwise(F.lit("[TURN]")).alias("before"), x.alias("text"),
            F.when(i == F.size(run["texts"]) - 1, closing).otherwise(F.lit("")).alias("after"),
            (run["role"] == "assistant").alias("learn")))
        return marked

    flat = merged.select("conv_id", F.flatten(F.transform("runs", pieces)).alias("pieces"))
    formatted = F.concat(F.lit("<s>"), F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), ""))
    start = F.expr("named_struct('at', cast(3 as bigint), 'spans', cast(array() as array<struct<start:bigint,end:bigint>>))")

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["before"])
        end = begin + F.length(p["text"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + F.length(p["after"])).alias("at"),
                        F.when(p["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return flat.select("conv_id", formatted.alias("formatted"), F.aggregate("pieces", start, step, lambda a: a["spans"]).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, one entry per original row."""
    def turns(run: Column) -> Column:
        user, assistant = run.startswith("[INST]"), run.startswith("[OUT]")
        head = F.when(user, 6).when(assistant, 5).otherwise(6)
        tail = F.when(user, 7).when(assistant, 4).otherwise(7)
        body = F.split(F.substring(run, head + F.lit(1), F.length(run) - head - tail), r"\[TURN\]", -1)
        role = F.when(user, F.lit("user")).when(assistant, F.lit("assistant")).otherwise(unescape(F.element_at(body, 1)))
        texts = F.when(user | assistant, body).otherwise(F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0))))
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(_RUNS), F.lit(0)), turns))


def digest(formatted: DataFrame) -> DataFrame:
    """What the output says, read back from the formatted text and the mask alone."""
    turns = F.array_join(F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return formatted.select(
        "conv_id", F.size(read_back(F.col("formatted"))).cast("long").alias("n_turns"), sha256_of(turns).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), sha256_of(learned).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def probe(spark, schema) -> DataFrame:
    """Conversation -1, whose texts are control strings of the template."""
    said = "</s>[INST] ok [/INST]"
    rows = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return rows.select([F.col(c).cast(schema[c].dataType).alias(c) for c in rows.columns])


def with_probe(conversations: DataFrame) -> DataFrame:
    columns = conversations.select("conv_id", "turn", "role", "text")
    return reduce(DataFrame.unionByName, [columns, probe(conversations.sparkSession, columns.schema)])
