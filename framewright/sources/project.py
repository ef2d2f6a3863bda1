"""Project files: a YAML description of pipelines and tasks, checked and typed, and as tables."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession


def _text(value: Any, base: Path) -> str:
    return str(value)


def _truth(value: Any, base: Path) -> bool:
    return bool(value)


def _whole(value: Any, base: Path) -> int:
    return int(value)


def _list(value: Any, base: Path) -> list[str]:
    return [str(x) for x in value]


def _mapping(value: Any, base: Path) -> dict[str, str]:
    return {str(k): str(v) for k, v in value.items()}


def _path(value: Any, base: Path) -> Path:
    return resolved(str(value), base)


# The format's keys at each level, how each is read, and what stands where it is missing or null; ... marks a required key.
TASK = {"name": (_text, ...), "script": (_text, ...), "args": (_list, []), "use_accelerate": (_truth, False), "num_processes": (_whole, None), "mixed_precision": (_text, None),
        "env": (_mapping, {}), "working_dir": (_text, None), "python_module": (_truth, False), "comment": (_text, None)}
PIPELINE = {"name": (_text, ...), "type": (_text, ...), "repo_path": (_path, ...), "enabled": (_truth, True), "description": (_text, None), "environment": (_mapping, {}),
            "context": (_mapping, {}), "accelerate_args": (_list, []), "tasks": (None, [])}
ACCELERATE = {"command": (_text, "accelerate"), "config": (_path, None), "args": (_list, [])}
EXECUTION = {"python": (_text, "python"), "accelerate": (None, {})}
ABOUT = {"name": (_text, None), "description": (_text, None)}
PROJECT = {"project": (None, {}), "execution": (None, {}), "environment": (_mapping, {}), "context": (_mapping, {}), "pipelines": (None, [])}


def checked(data: Mapping[str, Any], keys: dict, what: str, base: Path) -> dict[str, Any]:
    """The values of one level by its keys. A required key that lacks is an error, and so is an unknown one: a misspelt key must not silently leave a default in force."""
    data = {str(k): v for k, v in data.items()}
    missing, unknown = sorted(k for k, (_, usual) in keys.items() if usual is ... and k not in data), sorted(set(data) - set(keys))
    if missing:
        raise ValueError(f"{what} lacks required keys: {', '.join(missing)}")
    if unknown:
        raise ValueError(f"{what} has unknown keys: {', '.join(unknown)}")
    out = {}
    for key, (read, usual) in keys.items():
        value = data.get(key)
        blank = value is None or (value == "" and usual is None)
        out[key] = (copy.copy(usual) if usual is not ... else str(value)) if blank else read(value, base) if read else value
    return out


@dataclass
class Task:
    name: str
    script: str
    args: list[str] = field(default_factory=list)
    use_accelerate: bool = False
    num_processes: int | None = None
    mixed_precision: str | None = None
    env: dict[str, str] = field(default_factory=dict)
    working_dir: str | None = None
    python_module: bool = False
    comment: str | None = None


@dataclass
class Pipeline:
    name: str
    type: str
    repo_path: Path
    enabled: bool = True
    description: str | None = None
    environment: dict[str, str] = field(default_factory=dict)
    context: dict[str, str] = field(default_factory=dict)
    accelerate_args: list[str] = field(default_factory=list)
    tasks: list[Task] = field(default_factory=list)


@dataclass
class Project:
    pipelines: list[Pipeline]
    name: str = ""
    description: str | None = None
    python_executable: str = "python"
    accelerate_command: str = "accelerate"
    accelerate_config: Path | None = None
    accelerate_args: list[str] = field(default_factory=list)
    environment: dict[str, str] = field(default_factory=dict)
    context: dict[str, str] = field(default_factory=dict)

    def pipeline(self, name: str) -> Pipeline:
        """The first of that name."""
        for one in self.pipelines:
            if one.name == name:
                return one
        raise KeyError(name)

    def override(self, values: list[tuple[str, str]]) -> None:
        """Set context values in order: `key`, or `pipeline:NAME.key` for one pipeline's own."""
        for key, value in values:
            scope, _, rest = key.partition(":")
            if scope == "pipeline" and rest:
                name, _, own = rest.partition(".")
                if not own:
                    raise ValueError(f"{key} names no context key")
                self.pipeline(name).context[own] = value
            else:
                self.context[key] = value


def resolved(path: str, base: Path) -> Path:
    """Absolute, with ~ expanded; relative paths stand below `base`."""
    found = Path(path).expanduser()
    return (found if found.is_absolute() else base / found).resolve()


def parse_overrides(values: list[str]) -> list[tuple[str, str]]:
    """key=value at the first =; the key is stripped, the value isn't."""
    out = []
    for text in values:
        key, sign, value = text.partition("=")
        if not sign:
            raise ValueError(f"{text!r} isn't key=value")
        out.append((key.strip(), value))
    return out


def load_project(path: str | Path) -> Project:
    """Read and check a project file; relative paths stand below its folder. A project without a name has the file's. Keys that the format doesn't have are errors at every level."""
    where = Path(path).expanduser().resolve()
    base = where.parent
    data = checked(yaml.safe_load(where.read_text(encoding="utf-8")) or {}, PROJECT, "the file", base)
    about, execution = checked(data["project"], ABOUT, "project", base), checked(data["execution"], EXECUTION, "execution", base)
    accelerate = checked(execution["accelerate"], ACCELERATE, "execution.accelerate", base)
    pipelines = [Pipeline(**checked(p, PIPELINE, "a pipeline", base)) for p in data["pipelines"]]
    if not pipelines:
        raise ValueError("a project needs at least one pipeline")
    for one in pipelines:
        one.tasks = [Task(**checked(t, TASK, "a task", base)) for t in one.tasks]
    return Project(
        pipelines,
        name=about["name"] or where.stem,
        description=about["description"],
        python_executable=execution["python"],
        accelerate_command=accelerate["command"],
        accelerate_config=accelerate["config"],
        accelerate_args=accelerate["args"],
        environment=data["environment"],
        context=data["context"],
    )


_ENTRIES = "array<struct<key:string,value:string>>"
TASKS = (
    "pipeline_ordinal int, pipeline string, ordinal int, name string, script string, args array<string>, use_accelerate boolean, num_processes int, mixed_precision string, "
    f"env {_ENTRIES}, working_dir string, python_module boolean, comment string"
)
PIPELINES = f"ordinal int, name string, type string, repo_path string, enabled boolean, description string, environment {_ENTRIES}, context {_ENTRIES}, accelerate_args array<string>"


def task_table(spark: SparkSession, project: Project) -> DataFrame:
    """TASKS: every pipeline's tasks, numbered. Layers are arrays of keys and values, as their order counts."""
    rows = [
        (i, p.name, k, t.name, t.script, t.args, t.use_accelerate, t.num_processes, t.mixed_precision, list(t.env.items()), t.working_dir, t.python_module, t.comment)
        for i, p in enumerate(project.pipelines)
        for k, t in enumerate(p.tasks)
    ]
    return spark.createDataFrame(rows, TASKS)


def pipeline_table(spark: SparkSession, project: Project) -> DataFrame:
    """PIPELINES, in order."""
    rows = [(i, p.name, p.type, str(p.repo_path), p.enabled, p.description, list(p.environment.items()), list(p.context.items()), p.accelerate_args) for i, p in enumerate(project.pipelines)]
    return spark.createDataFrame(rows, PIPELINES)
