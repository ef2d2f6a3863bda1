"""Runs a project's tasks in order on the driver, or shows their commands."""

from __future__ import annotations

import argparse
import os
import subprocess
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from framewright.plans.context import VALUES, entries, folded, laid, mapped, rendered
from framewright.sources.project import Project, load_project, parse_overrides, pipeline_table, task_table

# Which parts of the work a task name stands for, as (detection, segmentation).
PARTS = {"detection": (True, False), "segmentation": (False, True), "both": (True, True)}


def parts(task: str) -> tuple[bool, bool]:
    if task not in PARTS:
        raise ValueError(f"unknown task {task!r}")
    return PARTS[task]


def check_adapters(task: str, detector: str | None, segmentor: str | None) -> None:
    """Each part of the work needs its adapter."""
    for wanted, adapter, name in zip(parts(task), (detector, segmentor), ("detection", "segmentation"), strict=True):
        if wanted and not adapter:
            raise ValueError(f"{name} needs an adapter")


def output_folders(task: str, out: str) -> tuple[str | None, str | None]:
    """Folders of detections and of segmentations: below `out` if both are made, else `out` itself."""
    detect, segment = parts(task)
    both = detect and segment
    return (f"{out}/detection" if both else out) if detect else None, (f"{out}/segmentation" if both else out) if segment else None


def steps(pipelines: DataFrame, tasks: DataFrame, project: Project, environment: Mapping[str, str]) -> DataFrame:
    """(pipeline_ordinal, ordinal, pipeline, task, command array, env map, changes map, folder) of the tasks of `pipelines` (PIPELINES) among `tasks` (TASKS).

    A pipeline's values are the environment, the project's context, its name, type and repo_path, and its own context, each rendered by
    what stands before; they are made once a pipeline and joined to its tasks. Commands, environments and folders are
    rendered by them. Relative paths stand below repo_path, `.` and `..` are resolved as text, a leading ~ is the environment's HOME.
    changes is what env has otherwise than `environment`.
    """
    base = F.map_from_entries(entries(environment)).cast(VALUES) if environment else F.create_map().cast(VALUES)
    about = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("pipeline", "name"), ("pipeline_type", "type"), ("repo_path", "repo_path"))))
    known = pipelines.select(F.col("ordinal").alias("pipeline_ordinal"), F.col("name").alias("pipeline"), "repo_path", "accelerate_args", F.col("environment").alias("layer"), folded(base, entries(project.context), about, F.col("context")).alias("values"))
    found = tasks.drop("pipeline").withColumnRenamed("name", "task").join(known, "pipeline_ordinal")
    values = F.col("values")
    texts = lambda items: F.transform(items, lambda x: rendered(x, values))
    script, home = rendered(F.col("script"), values), environment.get("HOME", "")
    options = [(f"--{n}", v) for n, v in (("config_file", F.lit(str(project.accelerate_config) if project.accelerate_config else None)), ("num_processes", F.col("num_processes").cast("string")), ("mixed_precision", F.when(F.col("mixed_precision") != "", F.col("mixed_precision"))))]
    launch = F.array(F.lit(project.accelerate_command), F.lit("launch"))
    for name, value in options:
        launch = F.concat(launch, F.when(value.isNotNull(), F.array(F.lit(name), value)).otherwise(F.array().cast("array<string>")))
    launch = F.concat(launch, texts(F.array(*map(F.lit, project.accelerate_args)).cast("array<string>")), texts(F.col("accelerate_args")))
    head = F.when(F.col("use_accelerate"), launch).otherwise(F.array(F.lit(project.python_executable)))
    call = F.when(F.col("python_module"), F.array(F.lit("-m"), script)).otherwise(F.array(below(script, F.col("repo_path"), home)))
    env = base
    for layer in (entries(project.environment), F.col("layer"), F.col("env")):
        env = laid(env, mapped(layer, values))
    folder = F.when(F.col("working_dir").isNull(), F.col("repo_path")).otherwise(below(rendered(F.col("working_dir"), values), F.col("repo_path"), home))
    changes = F.map_filter("env", lambda k, v: ~v.eqNullSafe(F.try_element_at(base, k)))
    out = found.select("pipeline_ordinal", "ordinal", "pipeline", "task", F.concat(head, call, texts(F.col("args"))).alias("command"), env.alias("env"), folder.alias("folder"))
    return out.select("pipeline_ordinal", "ordinal", "pipeline", "task", "command", "env", changes.alias("changes"), "folder")


def below(path: Column, base: Column, home: str) -> Column:
    """An absolute path as it is (~ is `home`), another one below `base` without `.` and `..`."""
    path = F.when(path.startswith("~/") | (path == "~"), F.concat(F.lit(home), F.substring(path, 2, 1 << 30))).otherwise(path)
    parts = F.filter(F.split(F.concat_ws("/", base, path), "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x)))
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def shown(command: Column) -> Column:
    """A command as a shell takes it."""
    quote = lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.array_join(F.transform(command, lambda x: F.when(x.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), x).otherwise(quote(x))), " ")


class Runner:
    """Enabled pipelines in order, each task after the one before; the first that fails ends the run. What to run is a plan; only running is the driver's."""

    def __init__(self, spark: SparkSession, project: Project, dry_run: bool = False, environment: dict[str, str] | None = None):
        self.spark, self.project, self.dry_run = spark, project, dry_run
        self.environment = dict(os.environ) if environment is None else environment

    def steps(self, only: Iterable[str] | None = None) -> DataFrame:
        """`steps` of the enabled pipelines, of those named in `only` if it is given, in order. A pipeline that isn't enabled stays out even if it is named; unknown names count for nothing."""
        names = None if only is None else self.spark.createDataFrame([(n,) for n in only], "name string")
        chosen = selected(pipeline_table(self.spark, self.project), names)
        return steps(chosen, task_table(self.spark, self.project), self.project, self.environment).orderBy("pipeline_ordinal", "ordinal")

    def run(self, only: Iterable[str] | None = None) -> list[Row]:
        done = []
        for step in self.steps(only).withColumn("shown", shown(F.col("command"))).collect():  # a project's tasks, which run here one by one
            if not self.dry_run:
                subprocess.run(step.command, env=step.env, cwd=step.folder, check=True)
            done.append(step)
        return done


def overview(pipelines: DataFrame) -> DataFrame:
    """(ordinal, name, type, status, description) for a listing of pipelines."""
    return pipelines.select("ordinal", "name", "type", F.when(F.col("enabled"), "enabled").otherwise("disabled").alias("status"), "description").orderBy("ordinal")


def selected(pipelines: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Enabled pipelines, of those named in `only` (name) if it is given."""
    enabled = pipelines.filter("enabled")
    return enabled if only is None else enabled.join(only.select("name").distinct(), "name", "left_semi")


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Run the pipelines of a project file.")
    parser.add_argument("--config", required=True)
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--verbose", action="store_true")
    parser.add_argument("--list", action="store_true")
    parser.add_argument("--only", nargs="+")
    parser.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    options = parser.parse_args(arguments)
    project = load_project(options.config)
    if options.list:
        for p in project.pipelines:
            print(f"{p.name} [{p.type}] {'enabled' if p.enabled else 'disabled'}" + (f": {p.description}" if p.description else ""))
        return 0
    try:
        project.override(parse_overrides(options.set))
    except (KeyError, ValueError) as e:
        parser.error(str(e))
    runner = Runner(SparkSession.builder.getOrCreate(), project, options.dry_run)
    for step in runner.run(options.only):
        print(f"{step.pipeline}/{step.task}: {step.shown}")
        if options.verbose:
            print(f"  in {step.folder}; " + ", ".join(f"{k}={v}" for k, v in step.changes.items()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
