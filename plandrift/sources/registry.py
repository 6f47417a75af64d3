"""The registry of documents, a JSON object by id, and the files that it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Code, Failure
from ..limits import DEFAULTS

ENTRY = "struct<underlying_document_id:string, revision_label:string, path:string, media_type:string, display_name:string, max_bytes:bigint, sheet_count:int>"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(pid, the fields of ENTRY), in the order of pid."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", f"map<string, {ENTRY}>")).alias("pid", "entry"))
    named = entries.select("pid", "entry.*")
    return named.withColumns({"underlying_document_id": F.coalesce("underlying_document_id", "pid"), "revision_label": F.coalesce("revision_label", F.lit("A")), "media_type": F.coalesce("media_type", F.lit("application/pdf"))}).orderBy("pid")


def contained(path: str, root: str) -> str:
    """path under root; one that leads out of it is an error."""
    parts: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if not parts:
                raise Failure(Code.PATH, f"{path} leads out of its folder")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    if path.startswith("/"):
        raise Failure(Code.PATH, "the path of a document is absolute")
    return f"{root.rstrip('/')}/{'/'.join(parts)}"


def resolve(registry: DataFrame, root: str, *pids: str) -> DataFrame:
    """The registry's rows of pids with source_uri, byte_size and sha256 of their files. Unknown ids and missing files are errors."""
    spark = registry.sparkSession
    found = {r["pid"]: r["path"] for r in registry.filter(F.col("pid").isin(*pids)).select("pid", "path").collect()}
    if missing := [p for p in pids if not found.get(p)]:
        raise Failure(Code.NOT_FOUND, f"no such document: {', '.join(missing)}")
    files = spark.createDataFrame([(p, contained(found[p], root)) for p in pids], "pid string, file string")
    content = spark.read.format("binaryFile").load([contained(found[p], root) for p in pids])
    hashed = content.select(F.regexp_replace("path", "^file:/*", "/").alias("_file"), F.col("path").alias("source_uri"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))
    own = files.withColumn("_file", F.regexp_replace("file", "^file:/*", "/"))
    return registry.join(own.join(hashed, "_file").drop("_file", "file"), "pid").filter(F.col("byte_size") <= F.coalesce("max_bytes", F.lit(DEFAULTS["file_bytes"])))
