"""Run-state and changelog sources, and the text and JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext import model
from chronotext.functions import scalars as S
from chronotext.operators.gate import stage_summary

_STATE = "session_id string, started_at double, tool string, runs array<struct<index: int, url: string, status: string, output_dir: string, coverage_json: string, notes_md: string, error: string, updated_at: double>>"


def parse_run_state(files: DataFrame) -> DataFrame:
    """Runs of run-state files (path, body). A body that can't be read is one failed run, so that a gate fails closed; an
    object without runs has none."""
    data = F.from_json("body", f"{_STATE}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = files.select("path", data.alias("d"))
    bad = F.col("d").isNull() | F.col("d._bad").isNotNull()
    failed = F.struct(*[(F.lit("failed") if n == "status" else F.col("path") if n == "output_dir" else F.concat(F.lit("unreadable run state: "), "path") if n == "error" else F.lit(None).cast(t)).alias(n) for n, t in (f.strip().split(" ") for f in model.RUNS.split(","))])
    return rows.select("path", F.explode(F.when(bad, F.array(failed)).otherwise(F.col("d.runs"))).alias("r")).select("path", "r.*")


def release_notes(changelogs: DataFrame, version: str) -> DataFrame:
    """(path, notes) of one version's section in changelogs (path, body); empty where there is none."""
    lines = F.transform(S.lines(F.col("body")), lambda x: x)
    rows = changelogs.select("path", F.posexplode(lines).alias("pos", "line"))
    quoted = "".join(c if c.isalnum() else f"\\{c}" for c in version)
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").rlike(rf"^## \[{quoted}\](?:\s|$)")
    stop = F.startswith("line", F.lit("## [")) | F.col("line").rlike(r"^\[[^\]]+\]:\s")
    start = F.min(F.when(head, F.col("pos"))).over(w)
    seen = rows.withColumn("_start", start).where(F.col("_start").isNotNull() & (F.col("pos") > F.col("_start")))
    open_ = seen.withColumn("_stops", F.sum(F.when(stop, 1).otherwise(0)).over(w)).where("_stops = 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    trim = lambda c: F.regexp_replace(F.regexp_replace(c, r"^(?:[^\S\n]*\n)+", ""), r"(?:\n[^\S\n]*)+$", "")
    found = open_.groupBy("path").agg(trim(text).alias("notes"))
    return changelogs.select("path").join(found, "path", "left").select("path", F.coalesce("notes", F.lit("")).alias("notes"))


def release_link(changelogs: DataFrame, version: str) -> DataFrame:
    """(path, link) of one version's reference line; empty where there is none."""
    quoted = "".join(c if c.isalnum() else f"\\{c}" for c in version)
    return changelogs.select("path", F.regexp_extract("body", rf"(?m)^\[{quoted}\]: (\S+)$", 1).alias("link"))


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON object a row, nulls kept."""
    w = df.write.option("ignoreNullFields", "false")
    (w.partitionBy(*by) if by else w).json(path)


def write_text(df: DataFrame, column: str, path: str, by: list[str] | None = None) -> None:
    """Texts, one a row, each ended by a line break; `by` gives each key a folder of its own."""
    w = df.select(*(by or []), F.regexp_replace(column, r"\n$", "").alias(column)).write
    (w.partitionBy(*by) if by else w).text(path)


def write_metrics(samples: DataFrame, path: str) -> None:
    """The summary of stage samples (stage, cpu, rss) as JSON, a stage a row."""
    write_json(stage_summary(samples), path)


def save_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("overwrite").parquet(path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.RUNS).parquet(path)
