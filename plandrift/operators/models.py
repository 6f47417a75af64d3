"""Who words an answer: from prompts (qid, prompt) to contents (qid, content, provider), a JSON object in text or null.

The extractive client needs no model and is built of Columns. A hosted model is a function that the caller hands in,
from prompts to (qid, content). Any client can stand in where another's content is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Code, Failure
from ..functions import text
from . import answers

Client = Callable[[DataFrame], DataFrame]
#: What a content is read as.
ANSWER = "answer string, citations array<string>, confidence string, unsupported boolean"
BLOCKS, LISTED_SNIPPETS, QUOTED = 12, 5, 500


def prompt(question: Column, labels: tuple[Column, Column], evidence: Column) -> Column:
    """A prompt: who is compared, the question, and a block ``[source_id] text`` for each of evidence, in order."""
    blocks = F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("["), e["source_id"], F.lit("] "), F.substring(e["text"], 1, QUOTED))), "\n")
    asked = F.concat(F.lit("Question: "), F.regexp_replace(question, r"\s+", " "))
    shape = F.lit('Answer as one JSON object: {"answer": text, "citations": [source ids from the evidence], "confidence": "high", "medium" or "low", "unsupported": true or false}')
    return F.concat_ws("\n", F.concat(F.lit("Revision A: "), labels[0]), F.concat(F.lit("Revision B: "), labels[1]), asked, F.lit(""), F.lit("Evidence:"), blocks, F.lit(""), shape)


def again(prompt_: Column, problem: Column, allowed: Column) -> Column:
    """The prompt once more, with what was wrong with the citations and those that are allowed."""
    return F.concat_ws("\n", prompt_, F.concat(F.lit("The citations were not valid: "), problem, F.lit(". Cite only these: "), F.array_join(allowed, ", "), F.lit(". If they don't back an answer, set unsupported to true and cite nothing.")))


def blocks(prompt_: Column) -> Column:
    """The evidence of a prompt: an array of (source_id, text)."""
    pattern = F.lit(r"(?s)\[((?:A|B|D):[^\]]+)\]\s*(.+?)(?=\n\[|\Z)")
    found = F.arrays_zip(F.regexp_extract_all(prompt_, pattern, F.lit(1)).alias("id"), F.regexp_extract_all(prompt_, pattern, F.lit(2)).alias("body"))
    return F.transform(found, lambda x: F.struct(F.trim(x["id"]).alias("source_id"), x["body"].alias("text")))


def extractive(prompts: DataFrame) -> DataFrame:
    """The best line of the evidence, with its id; where the question asks for a summary, the best few."""
    question = F.regexp_extract("prompt", r"Question:\s*(.+)", 1)
    rows = prompts.select("qid", question.alias("question"), F.posexplode(F.slice(blocks(F.col("prompt")), 1, BLOCKS)).alias("position", "b")).select("qid", "question", "position", "b.*")
    ranked = answers.extracted(rows, "qid", BLOCKS).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "source_id", "snippet"))).alias("r"))
    low = F.lower(F.col("question"))
    own = prompts.select("qid", question.alias("question")).join(ranked, "qid", "left")
    n = F.coalesce(F.size("r"), F.lit(0))
    ids, lines = F.transform("r", lambda x: x["source_id"]), F.transform("r", lambda x: x["snippet"])
    many, count = text.has_any(low, ("summarize", *answers.SURE)), F.contains(low, F.lit("how many")) & F.contains(low, F.lit("added"))
    added = F.size(F.filter(lines, lambda s: F.contains(F.lower(s), F.lit("added")))).cast("string")
    answer = F.when(n == 0, "There is no evidence to answer that.").when(many, F.concat(F.lit("Retrieved changes: "), F.array_join(F.slice(lines, 1, LISTED_SNIPPETS), " | "))).when(count, F.concat(F.lit("About "), added, F.lit(" added items appear in the evidence."))).otherwise(F.get(lines, F.lit(0)))
    cited = F.when(n == 0, F.array().cast("array<string>")).when(many, F.slice(ids, 1, LISTED_SNIPPETS)).when(count, F.slice(ids, 1, 3)).otherwise(F.slice(ids, 1, 1))
    sure = F.when(n == 0, "low").when(many, "high").otherwise("medium")
    body = F.to_json(F.struct(answer.alias("answer"), cited.alias("citations"), sure.alias("confidence"), (n == 0).alias("unsupported")))
    return own.select("qid", body.alias("content"), F.lit("extractive").alias("provider"))


def fixed(content: str) -> Client:
    """A client for tests, which always gives one content."""
    return lambda prompts: prompts.select("qid", F.lit(content).alias("content"), F.lit("fake").alias("provider"))


def hosted(call: Callable[[DataFrame], DataFrame], provider: str = "hosted") -> Client:
    return lambda prompts: prompts.select("qid").join(call(prompts).select("qid", "content"), "qid", "left").withColumn("provider", F.lit(provider))


def with_fallback(first: Client, second: Client) -> Client:
    """first, and second for the prompts of which first has no content; the provider says so."""

    def client(prompts: DataFrame) -> DataFrame:
        one = first(prompts)
        two = second(prompts.join(one.filter("content IS NULL").select("qid"), "qid", "left_semi"))
        return one.filter("content IS NOT NULL").unionByName(two.withColumn("provider", F.concat("provider", F.lit("_fallback"))))

    return client


def client(provider: str = "extractive", call: Callable[[DataFrame], DataFrame] | None = None) -> Client:
    """A client by name; a hosted one falls back to the extractive one."""
    named: dict[str, Client] = {"extractive": extractive, "none": extractive, "deterministic": extractive, "fake": fixed('{"answer": "fake", "citations": [], "confidence": "low", "unsupported": true}')}
    if provider == "hosted":
        return with_fallback(hosted(call), extractive) if call else extractive
    if provider not in named:
        raise Failure(Code.CONFIG, f"no such provider of answers: {provider}")
    return named[provider]


def read(content: Column) -> Column:
    """A struct of ANSWER from a content; what is no JSON object is an answer without citations that nothing supports."""
    parsed = F.from_json(content, ANSWER)
    none = F.array().cast("array<string>")
    bad = parsed.isNull() | parsed["answer"].isNull()
    return F.struct(
        F.when(bad, F.coalesce(content, F.lit(""))).otherwise(parsed["answer"]).alias("answer"),
        F.when(bad, none).otherwise(F.coalesce(parsed["citations"], none)).alias("citations"),
        F.when(bad, "low").otherwise(F.coalesce(parsed["confidence"], F.lit("medium"))).alias("confidence"),
        F.when(bad, True).otherwise(F.coalesce(parsed["unsupported"], F.lit(False))).alias("unsupported"),
    )
