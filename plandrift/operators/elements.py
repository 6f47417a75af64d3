"""Elements of a revision: normalised text, identifiers, kind, id, grid label, from raw rows with a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Code, failing
from ..functions import geometry, text
from ..limits import DEFAULTS


def build(rows: DataFrame, pid: Column, page: str = "page_number") -> DataFrame:
    """rows (raw_text, x0, y0, x1, y1, page, optionally kind_override, what a reader knows of the kind) with normalized_text, identifiers, kind, element_id and grid_region."""
    out = rows.withColumn("normalized_text", text.normalise(F.col("raw_text")))
    out = out.withColumn("identifiers", text.identifiers(F.col("normalized_text")))
    read = text.kind(F.col("normalized_text"), F.col("identifiers"))
    known = F.col("kind_override") if "kind_override" in rows.columns else F.lit(None).cast("string")
    out = out.withColumn("kind", F.when((known == "geometry_cluster") & (F.col("normalized_text") != ""), read).otherwise(F.coalesce(known, read)))
    box = geometry.box()
    return out.withColumns(
        {
            "element_id": text.element_id(pid, F.col(page), F.col("kind"), F.col("normalized_text"), *box),
            "grid_region": text.grid_label(*box),
        }
    )


def limits(elements: DataFrame, pages: DataFrame, key: str, most: dict[str, int] | None = None) -> DataFrame:
    """Of each revision: counts against the ceilings, and which are exceeded. elements (key, page, raw_text), pages (key, page_text)."""
    most = DEFAULTS | (most or {})
    by_page = elements.groupBy(key, "page").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("raw_text")).alias("longest"), F.sum(F.length("raw_text")).alias("chars"))
    own = by_page.groupBy(key).agg(F.max("n").alias("max_page_elements"), F.sum("n").alias("n_elements"), F.max("longest").alias("longest_element"), F.sum("chars").alias("element_chars"))
    texts = pages.groupBy(key).agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("page_text")).alias("page_chars"))
    out = texts.join(own, key, "left").fillna(0).withColumn("n_chars", F.col("page_chars") + F.col("element_chars"))
    checks = (("pages", "n_pages"), ("page_elements", "max_page_elements"), ("elements", "n_elements"), ("element_chars", "longest_element"), ("chars", "n_chars"))
    over = F.array_compact(F.array(*[F.when(F.col(c) > most[name], name) for name, c in checks]))
    return out.select(key, "n_pages", "max_page_elements", "n_elements", "longest_element", "n_chars", F.array_join(over, ",").alias("exceeded"))


def enforce(checked: DataFrame) -> DataFrame:
    """The rows of ``limits``; reading one that exceeds a ceiling raises."""
    return checked.withColumn("exceeded", F.when(F.col("exceeded") != "", failing(Code.LIMIT, F.col("exceeded"))).otherwise(F.col("exceeded")))


def require_unique(elements: DataFrame, *key: str) -> DataFrame:
    """elements with each key once; a key that comes twice can't be read without an error."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    twice = failing(Code.CORRUPT, F.concat_ws(" ", F.lit("not unique:"), *[F.col(k).cast("string") for k in key]))
    return elements.withColumn("_once", F.when(n > 1, twice).otherwise("")).filter("_once = ''").drop("_once")


def vector_clusters(boxes: DataFrame, page: str, cell: float = 1 / 24, fewest: int = 3, least_area: float = 20.0, most_area: float = 0.7, most: int = 80, page_area: float = 1.0) -> DataFrame:
    """Boxes gathered by the grid cell of their centre: hulls of ``fewest`` boxes or more with an area within bounds, at most ``most`` a page."""
    cx, cy = geometry.centre(geometry.box())
    cells = boxes.withColumns({"cell_x": F.floor(cx / cell), "cell_y": F.floor(cy / cell)})
    hulls = cells.groupBy(page, "cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    fit = hulls.filter((F.col("n") >= fewest) & (size >= least_area) & (size <= most_area * page_area))
    from pyspark.sql import Window

    order = Window.partitionBy(page).orderBy("cell_x", "cell_y")
    return fit.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).drop("_k")
