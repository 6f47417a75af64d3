"""Matching the elements of two revisions: candidates, pair scores, the best one-to-one assignment, what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry, similarity
from ..limits import CANDIDATE_RADII, MIN_MATCH_SCORE, SPATIAL_RADIUS, WEIGHTS
from .assignment import best_pairs, weights

# Kinds that may stand for one another
COMPATIBLE = {
    "text": ("note", "table_cell", "dimension", "equipment_tag", "instrument_tag", "line_tag"),
    "dimension": ("table_cell",),
    "symbol": ("geometry_cluster",),
    "geometry_cluster": ("image_region", "markup_cloud"),
}
FIELDS = ("element_id", "kind", "normalized_text", "identifiers", "x0", "y0", "x1", "y1")


def kind_compatibility(a: Column, b: Column) -> Column:
    """1 for equal kinds, 0.7 for kinds that may stand for one another, else 0."""
    near = F.lit(False)
    for kind, others in COMPATIBLE.items():
        near = near | ((a == kind) & b.isin(*others)) | ((b == kind) & a.isin(*others))
    return F.when(a == b, 1.0).when(near, 0.7).otherwise(0.0)


def semantic(elements: DataFrame, *side: str) -> DataFrame:
    """Elements without geometry that has no text; a side that has nothing else keeps all."""
    from pyspark.sql import Window

    full = (F.col("kind") != "geometry_cluster") | (F.col("normalized_text") != "")
    any_ = F.max(full).over(Window.partitionBy(*side))
    return elements.withColumn("_any", any_).filter(full | ~F.col("_any")).drop("_any")


def sides(a: DataFrame, b: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the key, FIELDS and, where there is one, extraction_confidence under names ending in _a and _b."""

    def named(rows: DataFrame, s: str) -> DataFrame:
        sure = [F.col("extraction_confidence").alias(f"extraction_{s}")] if "extraction_confidence" in rows.columns else []
        return rows.select(*key, *[F.col(f).alias(f"{f}_{s}") for f in FIELDS], *sure)

    return named(a, "a"), named(b, "b")


def candidates(a: DataFrame, b: DataFrame, key: list[str], radius: float = CANDIDATE_RADII * SPATIAL_RADIUS) -> DataFrame:
    """Pairs of one page whose centres are within radius or that share an identifier.

    One equi-join on (page, name): the names of an element are the grid cell of its centre, where one side also has
    the cells around it, and its identifiers. A pair that several names join is taken once: by its cell if it is
    near, else by the first identifier that both have.
    """
    one, two = sides(a, b, key)
    box_a, box_b = geometry.box(suffix="_a"), geometry.box(suffix="_b")
    cell = lambda v, shift=0: (F.floor(v / radius) + shift).cast("string")
    grid = lambda at, i=0, j=0: F.concat(F.lit("cell "), cell(at[0], i), F.lit(" "), cell(at[1], j))
    upper = lambda c: F.array_distinct(F.transform(F.col(c), F.upper))
    around = F.array(*[grid(geometry.centre(box_a), i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = one.withColumn("_name", F.explode(F.concat(around, upper("identifiers_a"))))
    right = two.withColumn("_name", F.explode(F.concat(F.array(grid(geometry.centre(box_b))), upper("identifiers_b"))))
    met = left.join(right, [*key, "_name"])
    near, by_cell = geometry.distance(box_a, box_b) <= radius, F.col("_name").startswith("cell ")
    first = F.get(F.array_intersect(upper("identifiers_a"), upper("identifiers_b")), F.lit(0))
    return met.filter((near & by_cell) | (~near & ~by_cell & (F.col("_name") == first))).drop("_name")


def scored(pairs: DataFrame, weights: dict[str, float] | None = None, matrix: list[float] | None = None) -> DataFrame:
    """Candidate pairs with the features identifier, text, spatial, type, geometry, distance and with score; those of score 0 are dropped."""
    w = WEIGHTS | (weights or {})
    fold = w["neighbor"] / 2  # nothing names neighbours, so their weight goes to place and text
    box_a = geometry.affine(geometry.box(suffix="_a"), matrix) if matrix else geometry.box(suffix="_a")
    box_b = geometry.box(suffix="_b")
    ta, tb = F.col("normalized_text_a"), F.col("normalized_text_b")
    ids_a, ids_b = (F.transform(f"identifiers_{s}", F.upper) for s in "ab")
    typed = pairs.withColumn("type", kind_compatibility(F.col("kind_a"), F.col("kind_b"))).filter("type > 0")
    out = typed.withColumns(
        {
            "ratio": similarity.ratio(ta, tb),
            "token_set": similarity.token_set_ratio(ta, tb),
            "distance": geometry.distance(box_a, box_b),
            "iou": geometry.iou(box_a, box_b),
            "geometry": geometry.shape(box_a, box_b),
            "_one": F.get(ids_a, F.lit(0)),
            "_two": F.get(ids_b, F.lit(0)),
        }
    )
    single = F.when((F.size(ids_a) == 1) & (F.size(ids_b) == 1), similarity.ratio(F.coalesce("_one", F.lit("")), F.coalesce("_two", F.lit(""))) / 100)
    out = out.withColumn("_single", single)
    several = best_identifier_ratio(F.col("identifiers_a"), F.col("identifiers_b"))
    empty = (F.size(ids_a) == 0) | (F.size(ids_b) == 0)
    both_geometry = (F.col("kind_a") == "geometry_cluster") & (F.col("kind_b") == "geometry_cluster")
    out = out.withColumns(
        {
            "identifier": F.when(empty, 0.0).when(F.arrays_overlap(ids_a, ids_b), 1.0).when(F.col("_single").isNotNull(), F.col("_single")).otherwise(several),
            "text": F.when((ta == "") & (tb == ""), F.when(both_geometry, 0.5).otherwise(0.0)).otherwise(0.6 * F.col("token_set") / 100 + 0.4 * F.col("ratio") / 100),
            "spatial": 0.6 * F.col("iou") + 0.4 * F.greatest(F.lit(0.0), 1.0 - F.col("distance") / 0.2),
        }
    )
    total = w["identifier"] * F.col("identifier") + (w["text"] + fold) * F.col("text") + (w["spatial"] + fold) * F.col("spatial") + w["type"] * F.col("type") + w["geometry"] * F.col("geometry")
    sure = (F.col("identifier") >= 1) & (F.col("text") > 0.6)
    return out.withColumn("score", F.when(sure, F.least(F.lit(1.0), total + 0.1)).otherwise(total)).drop("_one", "_two", "_single", "iou", "ratio", "token_set").filter("score > 0")


@F.pandas_udf(T.DoubleType())
def best_identifier_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best ratio of any identifier of one side with any of the other, from 0 to 1, where a side has several."""
    out = []
    for x, y in zip(a, b):
        several = x is not None and y is not None and len(x) and len(y) and len(x) + len(y) > 2
        pairs = [(i.upper(), j.upper()) for i in x for j in y] if several else []
        common = similarity.lcs_many([i for i, _ in pairs], [j for _, j in pairs])
        out.append(max((2.0 * c / max(1, len(i) + len(j)) for c, (i, j) in zip(common, pairs)), default=0.0))
    return pd.Series(out, dtype="float64")


def tie(a: Column, b: Column) -> Column:
    """A number below TIES by which equally good assignments are told apart."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", a, b).cast("binary")), 1, 4), 16, 10).cast("int")


def assigned(pairs: DataFrame, key: list[str], least: float = MIN_MATCH_SCORE) -> DataFrame:
    """The scored pairs of the best one-to-one assignment of each page; the threshold holds after solving.

    Scores are compared in millionths, and equal sums are told apart by ``tie``, so the result depends on nothing else.
    A task solves the pages that it holds one after another, streaming through them in order.
    """
    columns, schema = pairs.columns, pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            score, ties = rows["score"].to_numpy(), rows["_tie"].to_numpy()
            ends = [np.unique(rows["_page"].to_numpy(), return_inverse=True)[1]] * 2
            for k, side in enumerate("ab"):  # an end is a page and an element, numbered
                own = np.unique(np.array(rows[f"element_id_{side}"].to_pylist(), object).astype(str), return_inverse=True)[1]
                ends[k] = ends[k] * (int(own.max()) + 1) + own
            chosen = best_pairs(*ends, weights(score, ties))
            chosen = chosen[score[chosen] >= least]
            yield from rows.select(columns).take(chosen).to_batches()

        for batch in batches:  # in the order of pages: all but the last page of what is held is complete
            pages = batch["_page"].to_numpy()
            cut = int(np.searchsorted(pages, pages[-1])) if len(pages) else 0
            if cut or held and len(pages) and held[-1]["_page"][-1].as_py() != pages[-1]:
                yield from solved(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
        if held:
            yield from solved(pa.Table.from_batches(held))

    marked = pairs.withColumns({"_page": F.xxhash64(*key), "_tie": tie(F.col("element_id_a"), F.col("element_id_b"))})
    return marked.repartition(*key).sortWithinPartitions("_page").mapInArrow(run, schema)


def unmatched(elements: DataFrame, matches: DataFrame, key: list[str], side: str) -> DataFrame:
    """Elements of a side, a or b, that no match has."""
    return elements.join(matches.select(*key, F.col(f"element_id_{side}").alias("element_id")), [*key, "element_id"], "left_anti")


def page_work(a: DataFrame, b: DataFrame, key: list[str], most: int = 2_000_000) -> DataFrame:
    """Comparisons that each page would take without candidates, and whether they are more than allowed."""
    n = lambda rows, name: rows.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    return n(a, "n_a").join(n(b, "n_b"), key).withColumn("comparisons", F.col("n_a") * F.col("n_b")).withColumn("exceeded", F.col("comparisons") > most)
