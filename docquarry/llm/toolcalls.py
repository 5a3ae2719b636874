"""Operator 10, chat formatting: link tool calls with their results, order, validate and serialise them.

Built of DataFrame functions only. Calls and results are first reduced to one row an identifier (a third of
all rows may share one), then hash-joined. A call may name the call that it comes after; its level is its
depth in that forest, found by pointer doubling: each round joins every open pointer with the pointer that it
leads to, so a chain of n calls takes log2(n) rounds and no conversation is ever held in one task. Arguments
are parsed as JSON and held against the tool's schema; output is canonical JSON: keys in order, no spaces.

Defined results: a call without result is `unanswered`, a result without call `orphan` (level null); a call
on or behind a cycle has level null and `ordered` false; a repeated identifier keeps its first row in the
order of (position, content) and counts the others in n_calls or n_results; rows with null identifiers take
no part; arguments that are null or no JSON object, unknown tools, missing fields and wrong types are named
in `problem`; empty tables give an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.base import materialize


def levels(nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, level) of nodes(id, parent): 0 for roots; null on or behind a cycle. A parent not among the nodes counts as none."""
    known = nodes.select(F.col("id").alias("known"))
    state = nodes.join(known.hint("shuffle_hash"), F.col("parent") == F.col("known"), "left").select("id", F.col("known").alias("up"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("level"))
    state = materialize(state)
    total = state.count()
    rounds = min(max_rounds, max(1, total.bit_length()) + 1)
    for _ in range(rounds):
        if state.filter(F.col("up").isNotNull()).isEmpty():
            break
        above = state.select(F.col("id").alias("at"), F.col("up").alias("next"), F.col("level").alias("more"))
        state = materialize(state.join(above.hint("shuffle_hash"), F.col("up") == F.col("at"), "left").select("id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
    return state.select("id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def _problem(schemas: dict[str, dict[str, tuple[str, bool]]]) -> F.Column:
    """The first problem of (name, parsed), or null. schemas: tool -> field -> (types as schema_of_variant names them, required)."""
    parsed = F.col("parsed")
    out = F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit("arguments are no object"))
    for tool in sorted(schemas):
        for field in sorted(schemas[tool]):
            kinds, required = schemas[tool][field]
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            kind = F.schema_of_variant(value)
            here = F.col("name") == tool
            if required:
                out = out.when(here & value.isNull(), F.lit(f"missing {field}"))
            out = out.when(here & value.isNotNull() & ~F.coalesce(kind.rlike(f"^({kinds})"), F.lit(False)), F.lit(f"wrong type of {field}"))
    return out.when(~F.coalesce(F.col("name").isin(*sorted(schemas)), F.lit(False)), F.lit("unknown tool"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row an identifier. calls: id, name, arguments (JSON), after, position; results: id, content, position."""
    asked = calls.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("position", "arguments", "name", "after")).alias("c"), F.count("*").alias("n_calls"))
    asked = materialize(asked.select("id", "c.name", "c.arguments", "c.after", "n_calls"))
    told = results.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("position", "content")).alias("r"), F.count("*").alias("n_results")).select("id", F.col("r.content").alias("content"), "n_results")
    deep = levels(asked.select("id", F.col("after").alias("parent")))
    both = asked.join(deep.hint("shuffle_hash"), "id", "left").join(told.hint("shuffle_hash"), "id", "full_outer").withColumn("parsed", F.try_parse_json("arguments"))
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    message = F.to_json(F.struct(F.col("parsed").alias("arguments"), "id", "level", "name", F.col("content").alias("result")), {"ignoreNullFields": "false"})
    return both.select(
        "id",
        "name",
        status.alias("status"),
        F.col("level"),
        (F.col("level").isNotNull() & F.col("n_calls").isNotNull()).alias("ordered"),
        F.when(F.col("n_calls").isNotNull(), _problem(schemas)).alias("problem"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        message.alias("message"),
    )


#: The tools as which conversations' turns are read.
CHAT_SCHEMAS = {"ask": {"text": ("STRING", True), "turn": ("BIGINT|INT|SMALLINT|TINYINT|DECIMAL", True)}, "configure": {"mode": ("STRING", True), "text": ("STRING", True)}}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read turns as calls and results: user and system turns call, an assistant turn answers the turn before it, and each call comes after the one two turns earlier."""
    key = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    known = turns.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    calls = known.filter(F.col("role").isin("user", "system")).select(
        key(0).alias("id"),
        F.when(F.col("role") == "user", "ask").otherwise("configure").alias("name"),
        F.to_json(F.struct("turn", "text")).alias("arguments"),
        key(2).alias("after"),
        F.col("turn").alias("position"),
    )
    results = known.filter(F.col("role") == "assistant").select(key(1).alias("id"), F.col("text").alias("content"), F.col("turn").alias("position"))
    return calls, results
