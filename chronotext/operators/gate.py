"""Run state and the gate over a batch of runs; status roll-ups and stage summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext import model
from chronotext.functions.frames import union_all
from chronotext.functions.scalars import overall_status


def start_session(spark: SparkSession, urls: list[str]) -> DataFrame:
    """A fresh table of runs (index, url, status, ...), every URL pending."""
    rows = [(i, u, "pending", None, None, None, None, None) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, model.RUNS)


def resolve_notes(runs: DataFrame) -> DataFrame:
    """Add `notes_path` (given, or notes.md in the output folder or beside the coverage file) and `transcript_path`."""
    folder = F.regexp_replace("coverage_json", r"/?[^/]*$", "")
    beside = F.when(F.coalesce("coverage_json", F.lit("")) != "", F.when(folder == "", F.lit("notes.md")).otherwise(F.concat(folder, F.lit("/notes.md"))))
    inside = F.when(F.coalesce("output_dir", F.lit("")) != "", F.concat(F.regexp_replace("output_dir", "/$", ""), F.lit("/notes.md")))
    path = F.coalesce(F.nullif("notes_md", F.lit("")), inside, beside, F.lit(""))
    return runs.withColumn("notes_path", path).withColumn("transcript_path", F.regexp_replace(path, r"(^|/)[^/]*$", "$1transcript.md"))


def has_frame_png(runs: DataFrame, files: DataFrame) -> DataFrame:
    """Add `has_frames`: a .png lies in `frames` of the output folder or of the notes' folder. files: (path)."""
    roots = F.array_distinct(F.filter(F.array("output_dir", F.regexp_replace("notes_path", r"/?[^/]*$", "")), lambda x: F.coalesce(x, F.lit("")) != ""))
    own = runs.select("index", F.explode(roots).alias("root")).select("index", F.regexp_replace("root", "/$", "").alias("root"))
    held = files.where(F.lower("path").rlike(r"/frames/[^/]*\.png$")).select(F.regexp_replace("path", r"/frames/[^/]*$", "").alias("root")).distinct()
    found = own.join(held, "root", "left_semi").select("index").distinct().withColumn("has_frames", F.lit(True))
    return runs.join(found, "index", "left").withColumn("has_frames", F.coalesce("has_frames", F.lit(False)))


def run_problems(runs: DataFrame, coverage: DataFrame, notes_problems: DataFrame, present: DataFrame) -> DataFrame:
    """(index, rule, detail) of every run that isn't complete.

    runs: (index, status, url, output_dir, error); coverage: (index, overall_pass, gap_passed, scene_passed, artifacts_passed),
    a row only where it could be read; notes_problems: (index, rule, detail); present: (index, has_notes, has_transcript).
    A failed or pending run is reported as that; without coverage nothing else is looked at. The notes' own check is always
    made anew, whatever the recorded verdict."""
    name = F.coalesce("error", "url", "output_dir", F.lit(""))
    joined = runs.join(coverage.withColumn("_cov", F.lit(True)), "index", "left").join(present, "index", "left")
    failed, pending = F.col("status") == "failed", F.col("status") == "pending"
    live = ~(failed | pending)
    seen, bad = live & F.col("_cov").isNotNull(), ~F.coalesce("overall_pass", F.lit(False))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    notes_missing = seen & no("has_notes")
    found = [
        (failed, "failed", name),
        (pending, "pending", F.coalesce("url", "output_dir", F.lit(""))),
        (live & F.col("_cov").isNull(), "coverage_missing", F.lit("")),
        (seen & bad & no("gap_passed"), "gap", F.lit("")),
        (seen & bad & no("scene_passed"), "scene", F.lit("")),
        (seen & bad & no("artifacts_passed"), "artifacts", F.lit("")),
        (notes_missing, "notes_missing", F.lit("")),
        (seen & ~no("has_notes") & no("has_transcript"), "transcript_missing", F.lit("")),
    ]
    each = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), d.alias("detail"))) for c, r, d in found]))
    own = joined.select("index", F.explode(each).alias("p")).select("index", "p.rule", "p.detail")
    checked = joined.where(seen & ~no("has_notes") & ~no("has_transcript")).select("index")
    return union_all(own, notes_problems.select("index", "rule", "detail").join(checked, "index", "left_semi"))


def gate_report(runs: DataFrame, problems: DataFrame) -> DataFrame:
    """(index, label, n_problems, rules) of each run."""
    per = problems.groupBy("index").agg(F.count("*").alias("n_problems"), F.array_sort(F.collect_list("rule")).alias("rules"))
    label = F.coalesce(F.nullif("output_dir", F.lit("")), F.nullif("url", F.lit("")), F.concat(F.lit("run #"), F.col("index").cast("string")))
    return runs.select("index", label.alias("label")).join(per, "index", "left").select("index", "label", F.coalesce("n_problems", F.lit(0).cast("bigint")).alias("n_problems"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))


def gate_exit_code(problems: DataFrame) -> DataFrame:
    """One row (n_problems, exit_code): 2 where any problem is left; no runs pass."""
    return problems.agg(F.count("*").alias("n_problems")).withColumn("exit_code", F.when(F.col("n_problems") > 0, 2).otherwise(0))


def status_exit_code(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """exit_code of check items (status), for each group: 1 if any can't be fixed, 2 if any isn't ok, else 0."""
    worst = F.max(F.when(F.col("status") == "unfixable", 2).when(F.col("status") != "ok", 1).otherwise(0))
    code = F.when(F.col("_w") == 2, 1).when(F.col("_w") == 1, 2).otherwise(0)
    grouped = items.groupBy(*by) if by else items.groupBy()
    return grouped.agg(worst.alias("_w")).withColumn("exit_code", code).drop("_w")


def stage_summary(samples: DataFrame) -> DataFrame:
    """(stage, n, cpu_avg, cpu_peak, rss_mb_avg, rss_mb_peak) of samples (stage, cpu, rss bytes), one decimal."""
    one = lambda x: F.round(x, 1)
    return samples.groupBy("stage").agg(
        F.count("*").alias("n"), one(F.avg("cpu")).alias("cpu_avg"), one(F.max("cpu")).alias("cpu_peak"), one(F.avg("rss") / 1e6).alias("rss_mb_avg"), one(F.max("rss") / 1e6).alias("rss_mb_peak")
    )


def report_lines(items: DataFrame, by: list[str]) -> DataFrame:
    """(by..., report) of check items (by..., ord, name, status, detail, hint): a line for each, in order, then the overall status."""
    hint = F.when((F.col("status") != "ok") & (F.coalesce("hint", F.lit("")) != ""), F.concat(F.lit(" -> "), F.col("hint"))).otherwise("")
    line = F.concat(F.lit("["), F.col("status"), F.lit("] "), F.col("name"), F.lit(": "), F.coalesce("detail", F.lit("")), hint)
    lines = items.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("_text"))
    return lines.join(status_exit_code(items, by), by).select(*by, F.concat(F.col("_text"), F.lit("\n"), overall_status(F.col("exit_code"))).alias("report"))
