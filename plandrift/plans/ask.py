"""Answering many questions over the records of many runs in one plan.

Every table may carry the columns of a run's key, ``run``; questions meet only records of their own run, and the weights
of terms are those of a run. A question's id is its own over all runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..limits import ANSWER_CITED, ANSWER_LINES, PROXIMITY_RADIUS, PROXIMITY_WEIGHT, TOP_K
from ..operators import answers, changes, models, retrieval
from ..tables import stored

NOT_FOUND = "I could not find enough evidence in the compared revisions or their change report to answer that."


def _none() -> Column:
    return F.array().cast("array<string>")


def exact(asked: DataFrame, records: DataFrame, run: list[str]) -> DataFrame:
    """(qid, source_id) of records that have one of a question's tags, of asked (run, qid, tags).

    A tag ends in a digit and has three characters at least without hyphens. Both sides are joined on three characters
    that end in a digit, the tag's last ones and all that a record has, and the pairs are then looked at whole.
    """
    bare = lambda c: F.regexp_replace(F.upper(c), r"(?U)[\s-]+", "")
    body = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.array_join(F.coalesce("identifiers", _none()), " "))
    ends = F.array_distinct(F.regexp_extract_all(bare(body), F.lit(r"(?sU)(?=(..\d))"), F.lit(1)))
    told = records.select(*run, "source_id", F.explode(ends).alias("end"))
    tags = asked.select(*run, "qid", F.explode("tags").alias("t")).select(*run, "qid", F.substring(bare(F.col("t")), -3, 3).alias("end")).distinct()
    met = tags.join(told, [*run, "end"]).select(*run, "qid", "source_id").distinct()
    whole = met.join(records.select(*run, "source_id", "identifiers", F.col("text").alias("body")), [*run, "source_id"]).join(asked.select("qid", "tags"), "qid")
    return whole.filter(retrieval.exact_hit(F.col("tags"), F.coalesce("identifiers", _none()), F.col("body"))).select("qid", "source_id")


def search(questions: DataFrame, records: DataFrame, top: int = TOP_K, run: list[str] = []) -> DataFrame:
    """The best records of each question: (qid, source_id, score, position and the record's columns).

    questions: (run, qid, text). records: (run, source_id, source_family, text, identifiers, x0, y0, x1, y1). The weights
    of terms come from all records of a run, whatever families a question asks for.
    """
    asked = questions.select(*run, "qid", "text", text.route(F.col("text")).alias("route"), text.query_tags(F.col("text")).alias("tags"))
    body = records.select(*run, "source_id", F.concat_ws(" ", "text", F.array_join("identifiers", " ")).alias("text"))
    families = asked.select(*run, "qid", F.explode("route.families").alias("source_family"))
    allowed = lambda found: found.join(families, "qid").join(records.select(*run, "source_id", "source_family"), [*run, "source_id", "source_family"], "left_semi").select(*found.columns)
    lists = []
    for grams in (retrieval.word_grams, retrieval.char_grams):
        weights, idf = retrieval.fit(body, grams, ["source_id"], run)
        near = retrieval.cosine(retrieval.query_weights(questions, grams, idf, ["qid"], run), weights, "qid", "source_id", run)
        lists.append(retrieval.ranked(allowed(near.withColumn("similarity", F.round("similarity", 12))), "qid", "source_id", 3 * top))
    named = allowed(exact(asked, records, run)).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("source_id")) - 1)
    scores = retrieval.fused([named, *lists], "qid", "source_id")
    bare = lambda x: F.replace(F.replace(F.upper(x), F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))
    cx, cy = geometry.centre(geometry.box())
    tagged = asked.filter("route.proximity").select(*run, "qid", F.explode("tags").alias("tag")).select(*run, "qid", bare(F.col("tag")).alias("name")).distinct()
    placed = records.filter(F.col("source_family").isin("rev_a", "rev_b") & F.col("x0").isNotNull()).select(*run, F.explode("identifiers").alias("i"), cx.alias("ax"), cy.alias("ay"))
    anchors = tagged.join(placed.select(*run, bare(F.col("i")).alias("name"), "ax", "ay").distinct(), [*run, "name"]).select("qid", "ax", "ay")
    whole = scores.join(questions.select(*run, "qid"), "qid").join(records, [*run, "source_id"])
    near = retrieval.nearest_anchor(whole, anchors, ["qid"]).withColumn("score", F.col("score") + F.coalesce(retrieval.boost(F.col("nearest"), PROXIMITY_WEIGHT, PROXIMITY_RADIUS), F.lit(0.0)))
    return retrieval.top(near, "qid", "source_id", top)


def deterministic(questions: DataFrame, found: DataFrame, run: list[str]) -> DataFrame:
    """(qid, answer, cited, confidence, route) of the questions that the changes alone answer.

    found: (run, delta_item_id, change_type, confidence_band, description, page_number, box). Sure changes are listed in
    reading order, added ones counted, one change looked up by its id; an unknown id is left to retrieval.
    """
    if not run:  # one run, by a constant key
        run, questions, found = ["_run"], questions.withColumn("_run", F.lit(0)), found.withColumn("_run", F.lit(0))
    asked = questions.select(*run, "qid", "text", answers.deterministic_route(F.col("text")).alias("route")).filter("route IS NOT NULL")
    order = Window.partitionBy(*run).orderBy(*changes.reading_order("page_number"))
    sure = found.filter("confidence_band = 'high'").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= ANSWER_LINES)
    listed = sure.groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("_n", "delta_item_id", "description"))).alias("r"))
    added = found.groupBy(*run).agg(F.count_if(F.col("change_type") == "added").alias("n"))
    lines = F.array_join(F.transform("r", lambda x: F.concat(x["delta_item_id"], F.lit(": "), x["description"])), "\n")
    none = F.coalesce(F.size("r"), F.lit(0)) <= 0
    high = asked.filter("route = 'deterministic_high_conf'").join(listed, run, "left").select("qid", F.when(none, "There are no high-confidence changes in the delta report.").otherwise(F.concat(F.lit("High-confidence changes:\n"), lines)).alias("answer"), F.when(none, F.array(F.lit("D:summary"))).otherwise(F.transform(F.slice("r", 1, ANSWER_CITED), lambda x: F.concat(F.lit("D:"), x["delta_item_id"]))).alias("cited"), F.lit("high").alias("confidence"), "route")
    count = asked.filter("route = 'deterministic_count'").join(added, run, "left").select("qid", F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" items were classified as added.")).alias("answer"), F.array(F.lit("D:summary")).alias("cited"), F.lit("high").alias("confidence"), "route")
    item = F.upper(F.regexp_extract("text", r"(?iU)\b(D-[A-F0-9]+)\b", 1))
    one = asked.filter("route = 'deterministic_item'").withColumn("delta_item_id", item).join(found.select(*run, "delta_item_id", "description", "confidence_band").dropDuplicates([*run, "delta_item_id"]), [*run, "delta_item_id"])
    one = one.select("qid", F.col("description").alias("answer"), F.array(F.concat(F.lit("D:"), F.col("delta_item_id"))).alias("cited"), F.col("confidence_band").alias("confidence"), "route")
    return high.unionByName(count).unionByName(one)


def answer(questions: DataFrame, records: DataFrame, labels: tuple[str, str] = ("A", "B"), model: models.Client | None = None, found: DataFrame | None = None, run: list[str] = []) -> DataFrame:
    """(qid, answer, cited, confidence, route, unsupported, reason, provider) of each question (run, qid, text).

    In this order: a revision that isn't compared is refused; what the changes ``found`` answer alone needs no search; weak
    evidence is refused; else a client words an answer from the evidence. Citations that weren't retrieved or don't back
    the answer get the client one more try, with the citations that are allowed, and are then refused.
    """
    model = model or models.extractive
    asked = questions.select(*run, "qid", F.col("text").alias("question"), text.route(F.col("text"))["intent"].alias("route"), text.out_of_scope_revision(F.col("text"), F.array(*map(F.lit, labels))).alias("other"))
    known = deterministic(questions.join(asked.filter("other IS NULL").select("qid"), "qid", "left_semi"), found, run) if found is not None else None
    open_ = asked.filter("other IS NULL") if known is None else asked.filter("other IS NULL").join(known.select("qid"), "qid", "left_anti")
    hits = search(questions.join(open_.select("qid"), "qid", "left_semi"), records, run=run)
    evidence = F.transform(F.array_sort(F.collect_list(F.struct("position", "source_id", "text"))), lambda r: F.struct(r["source_id"], r["text"]))
    held = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), evidence.alias("evidence"))
    judged = open_.join(held, "qid", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "top": F.coalesce("top", F.lit(0.0))})
    blob = F.lower(F.array_join(F.transform(F.coalesce("evidence", F.array().cast("array<struct<source_id:string,text:string>>")), lambda e: e["text"]), " "))
    support = answers.support_score(F.col("question"), F.col("top"), blob)
    judged = stored(judged.withColumn("weak", answers.weak(F.col("n"), support, F.col("top"))), "judged")
    prompts = judged.filter("NOT weak").select("qid", models.prompt(F.col("question"), (F.lit(labels[0]), F.lit(labels[1])), F.col("evidence")).alias("prompt"), "evidence")

    first = stored(checked(model(prompts.select("qid", "prompt")), prompts), "contents")
    allowed = F.transform(F.slice("evidence", 1, TOP_K), lambda e: e["source_id"])
    bad = prompts.join(first.filter("status <> 'ok'").select("qid", "status"), "qid")
    second = checked(model(bad.select("qid", models.again(F.col("prompt"), F.col("status"), allowed).alias("prompt"))), prompts)
    made = first.filter("status = 'ok'").unionByName(second)

    none = _none()
    out = []
    scope = F.concat(F.lit(f"This comparison covers revisions {labels[0]} and {labels[1]} only; revision "), F.col("other"), F.lit(" is not part of it."))
    row = lambda rows, a, cited, sure, route, reason, provider, lost=None: rows.select("qid", a.alias("answer"), cited.alias("cited"), sure.alias("confidence"), route.alias("route"), (reason.isNotNull() if lost is None else lost).alias("unsupported"), reason.alias("reason"), provider.alias("provider"))
    refused, low = F.lit("refusal"), F.lit("low")
    out.append(row(asked.filter("other IS NOT NULL"), scope, none, low, F.lit("general"), F.lit("revision_out_of_scope"), refused))
    if known is not None:
        out.append(row(known, F.col("answer"), F.col("cited"), F.col("confidence"), F.col("route"), F.lit(None).cast("string"), F.lit("deterministic")))
    out.append(row(judged.filter("weak"), F.lit(NOT_FOUND), none, low, F.col("route"), F.lit("weak_retrieval"), refused))
    worded, good = made.join(open_.select("qid", "route"), "qid"), F.col("status") == "ok"
    out.append(row(worded, F.when(good, F.col("answer")).otherwise(F.lit(NOT_FOUND)), F.when(good, F.col("citations")).otherwise(none), F.when(good, F.col("confidence")).otherwise(low), F.when(good, F.col("route")).otherwise("citation_failure"), F.when(~good, F.col("status")), F.when(good, F.col("provider")).otherwise(refused), F.col("unsupported") | ~good))
    return changes.union(out)


def checked(contents: DataFrame, prompts: DataFrame) -> DataFrame:
    """(qid, answer, citations, confidence, unsupported, provider, status) of contents; an answer that claims nothing needs no citation."""
    said = contents.select("qid", "provider", models.read(F.col("content")).alias("a")).select("qid", "provider", "a.*")
    retrieved = prompts.select("qid", F.explode("evidence").alias("e")).select("qid", "e.source_id", F.col("e.text").alias("quote"))
    cited = said.filter("NOT unsupported").select("qid", "answer", F.explode("citations").alias("source_id")).distinct()
    status = answers.validated(cited, retrieved, "qid").select("qid", F.col("status").alias("_status"))
    return said.join(status, "qid", "left").withColumn("status", F.when(F.col("unsupported"), "ok").otherwise(F.coalesce("_status", F.lit("no_citation")))).drop("_status")
