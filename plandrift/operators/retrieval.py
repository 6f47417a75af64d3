"""Hybrid retrieval over records: exact tags, two TF-IDF rankings, rank fusion, proximity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..limits import EXACT_BOOST, LISTED, PROXIMITY_RADIUS, PROXIMITY_WEIGHT, RRF_K, TOP_K


def word_grams(t: Column) -> Column:
    """Words of two characters or more, lower-cased, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.transform(F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.concat(words, pairs)


def char_grams(t: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """3- to 5-grams of each word with a space around it; of a word that is no longer than a size, itself, and no larger sizes."""
    words = F.filter(F.split(F.lower(t), r"(?U)\s+"), lambda w: w != "")

    def of(word):
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        n = F.length(padded)
        grams = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(padded, i, F.lit(k)))
        out = F.array().cast("array<string>")
        for k in reversed(sizes):
            out = F.when(n <= k, F.array(padded)).otherwise(F.concat(grams(k), out))
        return out

    return F.flatten(F.transform(words, of))


def fit(records: DataFrame, grams, key: list[str], by: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """The weights (by, key, term, weight) of records (key, text), of length 1 for each, and the terms' (by, term, idf)."""
    tf = records.select(*by, *key, F.explode(grams(F.col("text"))).alias("term")).groupBy(*by, *key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    n = records.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if by else records.agg(F.count(F.lit(1)).alias("n"))
    counted = df.join(n, by) if by else df.crossJoin(F.broadcast(n))  # n: one row
    idf = counted.select(*by, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return normed(tf.join(idf, [*by, "term"]), [*by, *key]), idf


def normed(counts: DataFrame, key: list[str]) -> DataFrame:
    raw = counts.withColumn("raw", F.col("tf") * F.col("idf"))
    norms = raw.groupBy(*key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, key).select(*key, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def query_weights(questions: DataFrame, grams, idf: DataFrame, key: list[str], by: list[str] = []) -> DataFrame:
    tf = questions.select(*by, *key, F.explode(grams(F.col("text"))).alias("term")).groupBy(*by, *key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return normed(tf.join(idf, [*by, "term"]), [*by, *key])


def cosine(queries: DataFrame, weights: DataFrame, query_key: str, key: str, by: list[str] = []) -> DataFrame:
    """(query, key, similarity) for those that share a term: an inverted-index join."""
    return queries.withColumnRenamed("weight", "w").join(weights, [*by, "term"]).groupBy(query_key, key).agg(F.sum(F.col("w") * F.col("weight")).alias("similarity"))


def ranked(similar: DataFrame, query_key: str, key: str, depth: int = TOP_K * LISTED) -> DataFrame:
    """The first ``depth`` of each query with rank from 0; of equals, the one with the larger key first."""
    order = Window.partitionBy(query_key).orderBy(F.desc("similarity"), F.desc(key))
    return similar.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < depth)


def fused(lists: list[DataFrame], query_key: str, key: str, k: int = RRF_K, exact: int | None = 0) -> DataFrame:
    """(query, key, score) by reciprocal ranks over lists (query, key, rank); the list ``exact`` adds a boost. first_list and first_rank tell equals apart."""
    parts = [x.select(query_key, key, (1.0 / (k + F.col("rank") + 1) + (EXACT_BOOST if n == exact else 0.0)).alias("part"), F.struct(F.lit(n).alias("list"), F.col("rank").cast("long").alias("rank")).alias("first")) for n, x in enumerate(lists)]
    return reduce(DataFrame.union, parts).groupBy(query_key, key).agg(F.sum("part").alias("score"), F.min("first").alias("first"))


def top(scores: DataFrame, query_key: str, key: str, n: int = TOP_K) -> DataFrame:
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), "first", key)
    return scores.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def exact_hit(tags: Column, identifiers: Column, body: Column) -> Column:
    """Whether a record has one of a question's tags: as an identifier, or in its text, with or without hyphens."""
    ids = F.transform(identifiers, lambda i: F.replace(F.upper(i), F.lit(" "), F.lit("")))
    blob = F.replace(F.upper(F.coalesce(body, F.lit(""))), F.lit(" "), F.lit(""))
    bare = F.replace(blob, F.lit("-"), F.lit(""))
    lower = F.lower(F.coalesce(body, F.lit("")))
    return F.exists(tags, lambda t: F.array_contains(ids, t) | F.contains(blob, t) | F.contains(bare, F.replace(t, F.lit("-"), F.lit(""))) | F.contains(lower, F.lower(t)))


def nearest_anchor(records: DataFrame, anchors: DataFrame, key: list[str]) -> DataFrame:
    """records with ``nearest``: the distance from the centre to the nearest anchor (key, ax, ay), or null without one."""
    cx, cy = geometry.centre(geometry.box())
    near = records.join(anchors, key).groupBy(*key, "source_id").agg(F.min(F.sqrt((cx - F.col("ax")) * (cx - F.col("ax")) + (cy - F.col("ay")) * (cy - F.col("ay")))).alias("nearest"))
    return records.join(near, [*key, "source_id"], "left")


def boost(nearest: Column, weight: float = PROXIMITY_WEIGHT, radius: float = PROXIMITY_RADIUS) -> Column:
    return F.when(nearest <= radius, weight * (1.0 - nearest / radius)).otherwise(0.0)


def nearby_identifiers(changes: DataFrame, elements: DataFrame, key: list[str], radius: float = PROXIMITY_RADIUS) -> DataFrame:
    """(key, change_id, nearby): sorted identifiers of elements (key, identifiers, box) within radius of a change's centre.

    Grid cells of the radius's size make it an equi-join.
    """
    cell = lambda v, shift=0: (F.floor(v / radius) + shift).cast("int")
    cx, cy = geometry.centre(geometry.box())
    around = F.array(*[F.struct(cell(F.col("cx"), i).alias("gx"), cell(F.col("cy"), j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asked = changes.select(*key, "change_id", cx.alias("cx"), cy.alias("cy")).withColumn("g", F.explode(around)).select(*key, "change_id", "cx", "cy", "g.gx", "g.gy")
    named = elements.filter(F.size("identifiers") > 0).select(*key, "identifiers", cx.alias("ex"), cy.alias("ey"), cell(cx).alias("gx"), cell(cy).alias("gy"))
    dx, dy = F.col("cx") - F.col("ex"), F.col("cy") - F.col("ey")
    near = asked.join(named, [*key, "gx", "gy"]).filter(F.sqrt(dx * dx + dy * dy) <= radius)
    return near.groupBy(*key, "change_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("identifiers")))).alias("nearby"))


#: The columns of a record to search, beside the key of its run.
RECORD = ("source_id", "source_family", "page", "text", "entity_type", "identifiers", "x0", "y0", "x1", "y1", "change_type", "confidence_band")


def _record(rows: DataFrame, key: list[str], **values: Column) -> DataFrame:
    kinds = {"page": "bigint", "identifiers": "array<string>"} | dict.fromkeys(("x0", "y0", "x1", "y1"), "double")
    return rows.select(*key, *[values.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in RECORD])


def records(elements: DataFrame, pages: DataFrame, family: str, key: list[str] = []) -> DataFrame:
    """Records of one revision: its elements that have text or are geometry, and its pages' texts (page_number, page_text)."""
    prefix = {"rev_a": "A", "rev_b": "B"}[family]
    page, box = F.col("page_number"), {c: F.col(c) for c in ("x0", "y0", "x1", "y1")}
    named = lambda last: F.concat(F.lit(f"{prefix}:p"), page.cast("string"), F.lit(":"), last)
    own = elements.filter((F.col("normalized_text") != "") | (F.col("kind") == "geometry_cluster"))
    body = F.when(F.col("normalized_text") != "", F.col("normalized_text")).otherwise(F.concat(F.lit("["), F.col("kind"), F.lit("]")))
    drawn = _record(own, key, source_id=named(F.col("element_id")), source_family=F.lit(family), page=page, text=body, entity_type=F.col("kind"), identifiers=F.col("identifiers"), **box)
    texts = pages.filter(F.coalesce("page_text", F.lit("")) != "")
    return drawn.unionByName(_record(texts, key, source_id=named(F.lit("page_text")), source_family=F.lit(family), page=page, text=F.substring("page_text", 1, 2000), entity_type=F.lit("page_text"), identifiers=F.array()))


def change_records(changes: DataFrame, key: list[str] = []) -> DataFrame:
    """Records of changes with ``nearby``, the identifiers around them."""
    nearby = F.coalesce("nearby", F.array().cast("array<string>"))
    body = change_record_text(F.col("description"), F.col("before"), F.col("after"), F.col("change_type"), F.col("entity_type"), nearby)
    same = {c: F.col(c) for c in ("x0", "y0", "x1", "y1", "entity_type", "change_type", "confidence_band")}
    return _record(changes, key, source_id=F.concat(F.lit("D:"), F.col("delta_item_id")), source_family=F.lit("delta"), page=F.col("page_number"), text=body, identifiers=nearby, **same)


def summary_records(summaries: DataFrame, key: list[str]) -> DataFrame:
    """A record for each run's counts: (key, delta_id, total_changes, by_change_type, by_confidence_band, suppressed)."""
    listed = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string"))), ", ")
    body = F.concat(F.lit("Delta summary between "), F.concat_ws(" and ", *key), F.lit(": total changes "), F.col("total_changes").cast("string"), F.lit("; "), listed("by_change_type"), F.lit("; "), listed("by_confidence_band"), F.lit("; suppressed "), F.col("suppressed").cast("string"))
    name = F.concat(F.lit("D:"), F.coalesce("delta_id", F.lit("none")), F.lit(":summary"))
    return _record(summaries, key, source_id=name, source_family=F.lit("delta"), text=body, entity_type=F.lit("summary"), identifiers=F.array())


def change_record_text(describe: Column, before: Column, after: Column, kind: Column, entity: Column, nearby: Column) -> Column:
    filled = lambda c: F.nullif(c, F.lit(""))
    names = F.when(F.size(F.coalesce(nearby, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Nearby identifiers: "), F.array_join(nearby, ", ")))
    return F.concat_ws(" ", filled(describe), filled(before), filled(after), kind, entity, names)
