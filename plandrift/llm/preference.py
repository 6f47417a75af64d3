"""Preference formatting: chosen and rejected conversations share a rendered prompt and get masked completions.

A pair's prompt is the longest common prefix of its turns, rendered once; what each conversation has beyond it is
its completion, with the character spans of it that bear loss: the assistant's texts and the ends of those turns.

Pairs of a table of conversations: those with the same first turn (role and text), in the order of conv_id, are
alternatives, and each is chosen over the next. So a group of n gives n - 1 pairs, found by two-level neighbours
(blocks of conv_id first, then the blocks' edges) with no task that holds a whole group. A conversation that has
no next one is formatted alone: all before its last assistant turn is the prompt, and the rejected side is null.

Cases: a null role or text counts as empty. A null turn sorts first; turns with one number are ordered by role and
text. Rows that repeat are separate turns. Rows without conv_id belong to no conversation and are left out. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Conversations of a block of conv_ids within which neighbours are found, if the ids are spread evenly.
BLOCK = 1024
#: What stands before and after a turn's role and text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as an array of (role, text)."""
    own = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def neighbours(conversations: DataFrame) -> DataFrame:
    """(conv_id, next_id): the next larger conv_id with the same first turn, or null."""
    first = F.get("turns", F.lit(0))
    n, low, high = conversations.agg(F.count(F.lit(1)), F.min("conv_id"), F.max("conv_id")).first()
    width = max(1.0, (float(high) - float(low)) / n * BLOCK) if n else 1.0
    keyed = conversations.select("conv_id", F.sha2(F.to_json(first), 256).alias("key"), F.floor(F.col("conv_id") / F.lit(width)).alias("block"))
    inner = Window.partitionBy("key", "block").orderBy("conv_id")
    near = keyed.withColumn("next_id", F.lead("conv_id").over(inner))
    edges = keyed.groupBy("key", "block").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("conv_id"))
    outer = edges.select("conv_id", F.lead("low").over(Window.partitionBy("key").orderBy("block")).alias("far_id"))
    return near.join(outer, "conv_id", "left").select("conv_id", F.coalesce("next_id", "far_id").alias("next_id"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns two arrays of turns share at their start."""
    n = F.least(F.size(a), F.size(b))
    equal = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    return let(F.array_position(equal, False).cast("int"), lambda at: F.when(at == 0, n).otherwise(at - 1))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def loss_spans(turns: Column) -> Column:
    """The (start, end) characters of ``rendered(turns)`` that bear loss."""
    head = lambda t: F.length(t["role"]) + len(OPEN) + len(MIDDLE)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state, t):
        end = state["at"] + head(t) + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct((state["at"] + head(t)).alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step, lambda state: state["spans"])


def after(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.size(turns))


def last_assistant(turns: Column) -> Column:
    """How many turns stand before the last assistant turn; all, if there is none."""
    at = F.array_max(F.transform(turns, lambda t, k: F.when(t["role"] == "assistant", k)))
    return F.coalesce(at, F.size(turns))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Adds n_prompt_turns, prompt, chosen, rejected and the completions' loss spans to rows with chosen_turns and rejected_turns (or null)."""
    chosen, rejected = F.col("chosen_turns"), F.col("rejected_turns")
    n = F.when(rejected.isNull(), last_assistant(chosen)).otherwise(common_prefix(chosen, rejected))
    out = pairs.withColumn("n_prompt_turns", n)
    sides = {"chosen": after(chosen, F.col("n_prompt_turns")), "rejected": F.when(rejected.isNotNull(), after(rejected, F.col("n_prompt_turns")))}
    out = out.withColumns({f"_{k}": v for k, v in sides.items()})
    return out.withColumns({"prompt": rendered(F.slice(chosen, F.lit(1), F.col("n_prompt_turns"))), **{k: rendered(F.col(f"_{k}")) for k in sides}, **{f"{k}_spans": loss_spans(F.col(f"_{k}")) for k in sides}}).drop("_chosen", "_rejected", "chosen_turns", "rejected_turns")


def preference(turns: DataFrame) -> DataFrame:
    """A row for each conversation of (conv_id, turn, role, text), as chosen, with the one it is preferred to."""
    whole = conversations_of(turns)
    other = whole.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected_turns"))
    pairs = whole.join(neighbours(whole), "conv_id").select(F.col("conv_id").alias("chosen_id"), F.col("next_id").alias("rejected_id"), F.col("turns").alias("chosen_turns"))
    alone = pairs.filter(F.col("rejected_id").isNull()).withColumn("rejected_turns", F.lit(None).cast(whole.schema["turns"].dataType))
    paired = pairs.filter(F.col("rejected_id").isNotNull()).join(other, "rejected_id")
    return format_pairs(paired.unionByName(alone))


ORACLE_SQL = r"""
    WITH t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
               FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    n AS (SELECT conv_id AS chosen_id, turns AS a, lead(conv_id) OVER w AS rejected_id, lead(turns) OVER w AS b FROM t WINDOW w AS (PARTITION BY turns[1].role, turns[1].text ORDER BY conv_id)),
    p AS (SELECT *, CASE WHEN b IS NULL THEN coalesce(list_max(list_filter(list_transform(generate_series(1, len(a)), lambda k: CASE WHEN a[k].role = 'assistant' THEN k - 1 END), lambda x: x IS NOT NULL)), len(a))
                    ELSE coalesce(list_min(list_filter(generate_series(1, least(len(a), len(b))), lambda k: a[k] <> b[k])) - 1, least(len(a), len(b))) END AS n FROM n),
    r AS (SELECT chosen_id, rejected_id, n, list_transform(a, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS ra, list_transform(b, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS rb,
                 coalesce(list_sum(list_transform(a[n + 1:], lambda t: CASE WHEN t.role = 'assistant' THEN length(t.text) + 11 ELSE 0 END)), 0) AS la,
                 CASE WHEN b IS NOT NULL THEN coalesce(list_sum(list_transform(b[n + 1:], lambda t: CASE WHEN t.role = 'assistant' THEN length(t.text) + 11 ELSE 0 END)), 0) END AS lb FROM p)
    SELECT chosen_id, rejected_id, CAST(n AS INTEGER) AS n_prompt_turns, sha256(coalesce(array_to_string(ra[:n], ''), '')) AS prompt_sha256, sha256(coalesce(array_to_string(ra[n + 1:], ''), '')) AS chosen_sha256,
           CASE WHEN rb IS NOT NULL THEN sha256(coalesce(array_to_string(rb[n + 1:], ''), '')) END AS rejected_sha256, CAST(la AS INTEGER) AS chosen_loss_chars, CAST(lb AS INTEGER) AS rejected_loss_chars FROM r"""


def digests(formatted: DataFrame) -> DataFrame:
    """What of ``preference`` can be held against SQL: ids, digests of the three texts, characters that bear loss."""
    chars = lambda spans: F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["start"])
    hashed = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")]
    return formatted.select("chosen_id", "rejected_id", "n_prompt_turns", *hashed, *[chars(F.col(f"{c}_spans")).alias(f"{c}_loss_chars") for c in ("chosen", "rejected")])
