"""The calls that a server would answer, as functions with plain results: documents, runs, questions, the evaluation.

No server is part of this package; whoever serves these bounds the size of a body by MAX_BODY and answers errors with
``public_error``, which shows no place of the host's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Code, Failure
from .functions import text
from .operators import models, retrieval
from .plans import ask, compare
from .sinks import report
from .sinks import runs as written
from .sources import registry as documents
from .sources import runs as stored

MAX_BODY = 1_000_000
# Keys of an error's details that name places
PLACES = {"file", "filename", "local_path", "path", "root", "run_dir", "source_path", "source_uri"}


class Service:
    """Runs below ``root``, of the documents of a registry file, whose elements are rows (pid, page_number, raw_text, box)."""

    def __init__(self, spark: SparkSession, root: str, registry: str, rows: DataFrame, baseline: str | None = None) -> None:
        self.spark, self.root, self.rows, self.baseline = spark, root.rstrip("/"), rows, baseline
        self.registry = documents.read_registry(spark, registry)

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version}

    def pids(self) -> list[dict]:
        """What may be compared, without the files' places. A registry is short."""
        return [r.asDict() for r in self.registry.select("pid", "underlying_document_id", "revision_label", "display_name", "media_type").orderBy("pid").collect()]

    def run_pair(self, pid_a: str, pid_b: str, mode: str = "warn", run_id: str | None = None) -> str:
        """Compares two documents, stores the run and returns its id."""
        if mode not in ("warn", "strict", "force"):
            raise Failure(Code.CONFIG, "mode is warn, strict or force")
        known = {r["pid"] for r in self.registry.filter(F.col("pid").isin(pid_a, pid_b)).select("pid").collect()}
        if missing := {pid_a, pid_b} - known:
            raise Failure(Code.NOT_FOUND, f"no such document: {', '.join(sorted(missing))}")
        run_id = written.new(self.spark, f"{self.root}/runs", run_id)
        pairs = self.spark.createDataFrame([(pid_a, pid_b)], "pid_a string, pid_b string")
        rows = self.rows.filter(F.col("pid").isin(pid_a, pid_b))
        tables = compare.run_pairs(pairs, rows, mode=mode, registry=self.registry)
        written.store(self.spark, f"{self.root}/runs", run_id, tables, {"pid_a": pid_a, "pid_b": pid_b, "mode": mode})
        report.write_reports(self._tables(run_id)["changes"], f"{self.root}/runs/{run_id}/reports", *compare.PAIR)
        return run_id

    def _tables(self, run_id: str) -> dict[str, DataFrame]:
        return stored.load(self.spark, f"{self.root}/runs", run_id)

    def runs(self, limit: int = 20) -> list[dict]:
        return [r.asDict() for r in stored.listing(self.spark, f"{self.root}/runs", limit).collect()]

    def run(self, run_id: str) -> dict:
        """A run's counts, plausibility, warnings and the places of its files, relative to the server."""
        tables = self._tables(run_id)
        first = lambda name: next((r.asDict(recursive=True) for r in tables[name].limit(1).collect()), None)
        told = tables["compatibility"].select("score", "compatible", "reasons", "action").limit(1).collect()
        return {
            "request_id": run_id,
            "summary": first("summary"),
            "pair_compatibility": told[0].asDict() if told else None,
            "warnings": [r["warning"] for r in tables["warnings"].select("warning").distinct().orderBy("warning").limit(1000).collect()],
            "paths": {name: f"/api/runs/{run_id}/file/{name}" for name in ("changes", "reports/markdown", "reports/html", "request.json", "metrics.json")},
        }

    def file(self, run_id: str, name: str) -> bytes:
        """A small file of a run; a name that leads out of the run's folder is an error."""
        path = documents.contained(name, f"{self.root}/runs/{written.valid(run_id)}")
        found = self.spark.read.format("binaryFile").load(path).select("content").limit(1).collect() if written.files(self.spark, path)[0].exists(written.files(self.spark, path)[1]) else []
        if not found:
            raise Failure(Code.NOT_FOUND, "no such file")
        return bytes(found[0][0])

    def chat(self, run_id: str, question: str, client: models.Client | None = None) -> dict:
        """One question about a run."""
        tables = self._tables(run_id)
        asked = self.spark.createDataFrame([(1, question)], "qid long, text string")
        labels = [r["revision_label"] for p in ("pid_a", "pid_b") for r in tables["summary"].select(F.col(p).alias("pid")).join(self.registry, "pid").select("revision_label").collect()]
        found = ask.answer(asked, tables["records"].select(*retrieval.RECORD), tuple(labels) or ("A", "B"), client, tables["changes"])
        return found.first().asDict()

    def eval_latest(self) -> dict:
        return stored.latest_scorecard(self.spark, f"{self.root}/eval", self.baseline).first().asDict()


def public(value, key: str = ""):
    """A value to show: texts without absolute paths, nothing of keys that name places; lists and maps all the way down."""
    if key.lower() in PLACES:
        return text.REDACTED
    if isinstance(value, str):
        return text.without_paths(value)
    if isinstance(value, dict):
        return {str(k): public(v, str(k)) for k, v in value.items()}
    return [public(v) for v in value] if isinstance(value, (list, tuple)) else value


def public_error(error: Failure, **details) -> dict:
    return public({"code": str(error.code), "message": str(error), "details": details})
