"""python -m plandrift COMMAND: what can be done from a shell.

    queries                                   names of the catalogue's queries
    query NAME SF_DIR [OUT]                   runs one, and shows or writes its rows
    pids REGISTRY                             documents of a registry
    run-pair ROOT REGISTRY ROWS A B [MODE]    compares two documents, whose elements are Parquet rows, and stores the run
    runs ROOT                                 the newest runs
    chat ROOT REGISTRY RUN QUESTION           answers from a stored run
    eval-compare BASELINE CURRENT             holds two scorecards against each other
    settings [FILE]                           the settings in force
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue, settings
from .errors import Failure
from .operators import evaluation
from .service import Service
from .sinks import report
from .sources import registry, runs

ROWS = "pid string, page_number int, raw_text string, x0 double, y0 double, x1 double, y1 double"


def _spark() -> SparkSession:
    return SparkSession.builder.appName("plandrift").getOrCreate()


def _lines(rows: DataFrame) -> None:
    for r in rows.toJSON().collect():
        print(r)


def run(command: str, *args: str) -> None:
    if command == "queries":
        print("\n".join(sorted(catalogue.queries())))
    elif command == "query":
        rows = catalogue.queries()[args[0]](_spark(), args[1])
        rows.write.mode("overwrite").parquet(args[2]) if len(args) > 2 else rows.show(truncate=False)
    elif command == "pids":
        _lines(registry.read_registry(_spark(), args[0]).select("pid", "underlying_document_id", "revision_label", "display_name"))
    elif command == "run-pair":
        spark = _spark()
        print(Service(spark, args[0], args[1], spark.read.parquet(args[2])).run_pair(*args[3:6]))
    elif command == "runs":
        _lines(runs.listing(_spark(), f"{args[0]}/runs"))
    elif command == "chat":
        spark = _spark()
        print(json.dumps(Service(spark, args[0], args[1], spark.createDataFrame([], ROWS)).chat(args[2], " ".join(args[3:])), ensure_ascii=False))
    elif command == "eval-compare":
        spark = _spark()
        body = lambda path, name: spark.read.text(path, wholetext=True).select(F.lit(name).alias("run"), F.col("value").alias("body"))
        found = evaluation.scorecards_compared(body(args[0], "baseline").unionByName(body(args[1], "current")), "baseline", "current")
        print(report.comparison_text(found["metrics"]).first()["text"])
        if found["verdict"].first()["has_regression"]:
            raise SystemExit(1)
    elif command == "settings":
        print(json.dumps(settings.load(*args[:1]), indent=1, sort_keys=True))
    else:
        print(__doc__)


def main(args: list[str]) -> int:
    try:
        run(*(args or ["help"]))
    except Failure as e:
        print(e, file=sys.stderr)
        return 2
    except (IndexError, TypeError):
        print(__doc__, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
