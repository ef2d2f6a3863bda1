from __future__ import annotations

import shlex
import struct
import subprocess
import sys
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.operators import parameters as P
from framewright.operators.inference import infer
from framewright.plans import context
from framewright.plans.runner import Runner, below, check_adapters, main, output_folders, overview, parts, selected, shown
from framewright.sources import images
from framewright.sources.project import load_project, parse_overrides, pipeline_table, task_table


def png(kind: int, width: int, height: int, raster: bytes) -> bytes:
    """kind: 0 grey, 2 RGB, 6 RGB and alpha."""
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    step = len(raster) // height
    lines = b"".join(b"\0" + raster[i * step : (i + 1) * step] for i in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a-b").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(png(2, 2, 1, bytes([255, 0, 10, 1, 2, 3])))
    (tmp_path / "a-b" / "x.png").write_bytes(png(0, 1, 1, b"\x07"))
    (tmp_path / "a" / "y.png").write_bytes(png(6, 1, 1, bytes([9, 8, 7, 128])))
    (tmp_path / "broken.jpg").write_bytes(b"no image")
    (tmp_path / "UPPER.PNG").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path


def test_listing_order_suffixes_and_errors(spark, folder, tmp_path):
    names = [r.path.split(str(folder))[1] for r in images.listing(spark, f"file://{folder}").collect()]
    assert names == ["/a/x.png", "/a/y.png", "/a-b/x.png", "/broken.jpg"]
    assert images.listing(spark, f"file://{folder}/notes.txt").count() == 1
    with pytest.raises(FileNotFoundError):
        images.listing(spark, f"file://{folder}/missing")
    (tmp_path / "void").mkdir()
    with pytest.raises(ValueError, match="no images"):
        images.listing(spark, f"file://{tmp_path}/void")


def test_pixels_are_rgb(spark, folder):
    rgb = images.pixels(images.frames(spark, f"file://{folder}"))
    found = sorted((r.frame.split("/")[-2:], r.x, r.r, r.g, r.b) for r in rgb.collect())
    assert found == [(["a", "x.png"], 0, 255, 0, 10), (["a", "x.png"], 1, 1, 2, 3), (["a", "y.png"], 0, 9, 8, 7), (["a-b", "x.png"], 0, 7, 7, 7)]
    one = images.segmentor_input(rgb).filter("r > 2").first()
    assert one.r == pytest.approx((1 - 0.485) / 0.229, rel=1e-6)
    assert images.detector_input(rgb).agg(F.max("r")).first()[0] == 1.0


def test_pixels_of_large_frames(spark):
    size = 300
    data = bytes((7 * k) % 256 for k in range(size * size * 4))
    rows = [("a", size, size, 4, data), ("b", 1, 2, 1, b"\x05\x06")]
    rgb = images.pixels(spark.createDataFrame(rows, "frame string, height int, width int, channels int, data binary"))
    found = {(r.frame, r.y, r.x): (r.r, r.g, r.b) for r in rgb.collect()}
    assert len(found) == size * size + 2 and found["b", 0, 1] == (6, 6, 6)
    for y, x in ((0, 0), (299, 299), (218, 136), (218, 135)):
        at = (y * size + x) * 4
        assert found["a", y, x] == (data[at + 2], data[at + 1], data[at])


def test_stem_and_suffix(spark):
    df = spark.createDataFrame([("/a/b.tar.gz",), ("/a.d/plain",), ("/a/.hidden",)], "p string")
    assert [tuple(r) for r in df.select(images.stem(F.col("p")), images.suffix(F.col("p"))).collect()] == [("b.tar", ".gz"), ("plain", ""), (".hidden", "")]


def test_model_slot(spark):
    def load():
        return lambda batch: pd.DataFrame({"n": batch["id"] * 2})

    assert [r.n for r in infer(spark.range(3).coalesce(1), load, "n long").collect()] == [0, 2, 4]


PARAMS = [
    (0, "backbone.blocks.0.weight", True, [8, 8], "f"), (1, "head.box.weight", True, [81, 4], "f"), (2, "head.norm.weight", True, [8], "f"), (3, "decoder.class.weight", True, [150, 4], "f"),
    (4, "fc.weight", True, [19, 3], "f"), (5, "fc.meta", False, None, "dict"), (6, "x.Blocks", True, [1], "f"),
]


def test_key_marks_are_fixed():
    assert P.CATEGORIES == {
        "backbone": (("blocks", "patch_embed", "pos_embed"), 5),
        "detection": (("detector", "rpn", "roi", "box", "class"), 5),
        "segmentation": (("decoder", "head", "mask_embed", "query"), 10),
        "output": (("fc", "classifier", "linear"), 10),
    }
    assert (P.HEAD_MARKS, P.HEADS, P.LISTED, P.NOT_METADATA) == (("head", "decoder", "classifier", "fc"), 10, 30, ("model", "state_dict"))


def test_parameter_reports(spark):
    params = spark.createDataFrame(PARAMS, "ordinal int, key string, is_tensor boolean, shape array<bigint>, dtype string")
    assert [(r.module, r.n) for r in P.modules(params).collect()] == [("head", 2), ("fc", 2), ("backbone", 1), ("decoder", 1), ("x", 1)]
    assert {r.category: r.n for r in P.categories(params).collect()} == {"backbone": 1, "detection": 2, "segmentation": 3, "output": 2, "total": 7}
    assert [r.key for r in P.category_keys(params, "output").collect()] == ["fc.weight"]
    assert [(r.out_dim, r.dataset) for r in P.heads(params, "segmentation").collect()] == [(81, "unknown"), (150, "ADE20K"), (19, "Cityscapes")]
    assert [r.dataset for r in P.heads(params, "detection").collect()] == ["COCO", None, None]
    assert P.listing(params, 2).collect()[0].shape == "(8, 8)"
    top = spark.createDataFrame([("model",), ("epoch",)], "key string")
    assert [r.key for r in P.metadata(top).collect()] == ["epoch"]
    files = spark.createDataFrame([("lvd1689m.pth", 15 * 1024**3), ("lvd1689m.pth", 15 * 1024**3 - 1), ("other", 1)], "path string, length long")
    assert [r.is_complete for r in P.complete(files).collect()] == [True, False, True]


PROJECT = """
project: {name: demo, description: two lines}
execution: {python: py, accelerate: {command: acc, config: acc.yaml, args: ["--x={tag}"]}}
environment: {ROOT: "{base}/r"}
context: {base: /data, tag: t, nested: "{base}/n"}
pipelines:
  - name: one
    type: vision
    repo_path: code
    context: {out: "{nested}/{pipeline}"}
    accelerate_args: ["--p"]
    tasks:
      - {name: plain, script: run.py, args: ["--out", "{out}", "{missing}", "{{x}}"], env: {A: "{pipeline_type}"}}
      - {name: fast, script: "pkg.mod", python_module: true, use_accelerate: true, num_processes: "2", mixed_precision: bf16}
  - {name: spare, type: vision, repo_path: /abs, enabled: false, tasks: [{name: t, script: s}]}
  - {name: truthy, type: vision, repo_path: /abs, enabled: "false"}
"""


@pytest.fixture
def project_file(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text(PROJECT)
    return path


def test_commands_and_environment(spark, project_file, tmp_path):
    project = load_project(project_file)
    found = Runner(spark, project, environment={"HOME": "{not a template"}).steps()
    plain, fast = found.collect()
    assert plain.command == ["py", str(tmp_path / "code/run.py"), "--out", "/data/n/one", "", "{x}"]
    assert plain.env["A"] == "vision" and plain.env["ROOT"] == "/data/r" and plain.folder == str(tmp_path / "code")
    assert fast.command == ["acc", "launch", "--config_file", str(tmp_path / "acc.yaml"), "--num_processes", "2", "--mixed_precision", "bf16", "--x=t", "--p", "-m", "pkg.mod"]
    assert plain.changes == {"ROOT": "/data/r", "A": "vision"} and fast.changes == {"ROOT": "/data/r"} and plain.env["HOME"] == "{not a template"
    words = ["a", "", "it's", "x y", "/p-1_=:,.@%+", "é", "$HOME", '"']
    assert spark.range(1).select(shown(F.array(*map(F.lit, words)))).first()[0] == shlex.join(words)


def test_paths_below_a_folder(spark):
    paths = ["a", "./a/../b", "../../../x", "/abs/../y", "~/z", "~", "", "a//b/"]
    found = spark.range(1).select(*(below(F.lit(p), F.lit("/r/s"), "/home/me").alias(str(k)) for k, p in enumerate(paths))).first()
    assert list(found) == ["/r/s/a", "/r/s/b", "/x", "/abs/../y", "/home/me/z", "/home/me", "/r/s", "/r/s/a/b"]


def test_tasks_run_in_order_and_the_first_failure_ends_the_run(spark, tmp_path):
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "t.py").write_text("import os, sys\nopen('log', 'a').write(sys.argv[1] + os.environ['K'] + os.getcwd()[-4:] + ' ')\nsys.exit(sys.argv[1] == 'bad')")
    tasks = ", ".join(f"{{name: {n}, script: t.py, args: ['{n}'], env: {{K: '{{tag}}'}}}}" for n in ("one", "bad", "two"))
    path = tmp_path / "p.yaml"
    path.write_text(f"execution: {{python: '{sys.executable}'}}\ncontext: {{tag: '1'}}\npipelines:\n  - {{name: a, type: b, repo_path: code, tasks: [{tasks}]}}\n  - {{name: a, type: b, repo_path: code, context: {{tag: '2'}}, tasks: [{{name: last, script: t.py, args: [last]}}]}}")
    runner = Runner(spark, load_project(path))
    with pytest.raises(subprocess.CalledProcessError):
        runner.run()
    assert (tmp_path / "code" / "log").read_text() == "one1code bad1code "
    assert [r.task for r in runner.steps().collect()] == ["one", "bad", "two", "last"] and runner.steps([]).count() == 0


def test_project_keys(project_file, tmp_path):
    project = load_project(project_file)
    assert (project.name, project.description, project.python_executable) == ("demo", "two lines", "py")
    assert project.accelerate_config == (tmp_path / "acc.yaml").resolve()
    one = "pipelines: [{name: a, type: b, repo_path: c}]"
    for text, what in (("execution: {python_executable: x}", "python_executable"), ("execution: {accelerate: {config_file: x}}", "config_file"), ("project: {title: x}", "title"), ("pipelnes: []", "pipelnes")):
        path = tmp_path / "unknown.yaml"
        path.write_text(f"{text}\n{one}")
        with pytest.raises(ValueError, match=what):
            load_project(path)
    for text, what in (("pipelines: [{name: a, type: b, repo_path: c, enable: false}]", "enable"), ("pipelines: [{name: a, type: b, repo_path: c, tasks: [{name: x, script: s, argz: []}]}]", "argz")):
        path.write_text(text)
        with pytest.raises(ValueError, match=what):
            load_project(path)
    path = tmp_path / "nameless.yaml"
    path.write_text(f"execution: {{accelerate: {{config: null}}}}\n{one}")
    assert load_project(path).name == "nameless" and load_project(path).accelerate_config is None and load_project(path).python_executable == "python"


def test_overrides_and_selection(project_file, spark):
    project = load_project(project_file)
    project.override(parse_overrides([" tag = a=b", "pipeline:one.out=/o", "tag=later"]))
    assert project.context["tag"] == "later" and Runner(spark, project, environment={}).steps().first().command[3] == "/o"
    assert Runner(spark, project).steps(["spare", "nobody"]).collect() == []
    with pytest.raises(KeyError):
        project.override([("pipeline:nobody.x", "1")])
    with pytest.raises(ValueError):
        parse_overrides(["novalue"])
    table = pipeline_table(spark, project)
    assert [(r.name, r.status) for r in overview(table).collect()] == [("one", "enabled"), ("spare", "disabled"), ("truthy", "enabled")]
    only = spark.createDataFrame([("one",), ("spare",), ("nobody",)], "name string")
    assert [r.name for r in selected(table, only).collect()] == ["one"]
    assert task_table(spark, project).filter("use_accelerate").first().num_processes == 2


def test_checks(tmp_path):
    for text, what in (("", "at least one"), ("pipelines: [{name: a}]", "repo_path, type"), ("pipelines: [{name: a, type: b, repo_path: c, tasks: [{name: x}]}]", "script")):
        path = tmp_path / "bad.yaml"
        path.write_text(text)
        with pytest.raises(ValueError, match=what):
            load_project(path)


def test_templates(spark):
    one = spark.range(1)
    values = F.create_map(F.lit("a"), F.lit("1"), F.lit("n"), F.lit(None).cast("string"))
    assert one.select(context.rendered(F.lit("{a}{b}{{c}}\n{n}é"), values)).first()[0] == "1{c}\né" and one.select(context.rendered(F.lit(""), values)).first()[0] == ""
    for bad in ("{", "{}", "{0}", "{a.b}", "}"):
        with pytest.raises(Exception, match="stray brace"):
            one.select(context.rendered(F.lit(bad), values)).collect()
    built = context.folded(context.mapped(context.entries({"a": "{{"}), values), context.entries({"b": "x{a}"}), context.entries({"b": "{b}y", "c": "{b}"}))
    assert one.select(built).first()[0] == {"a": "{", "b": "x{y", "c": "x{y"}


def test_parts():
    assert parts("both") == (True, True) and output_folders("both", "o") == ("o/detection", "o/segmentation") and output_folders("detection", "o") == ("o", None)
    check_adapters("detection", "a", None)
    with pytest.raises(ValueError):
        check_adapters("both", "a", None)
    with pytest.raises(ValueError):
        parts("none")


def test_command_line(spark, project_file, capsys):
    assert main(["--config", str(project_file), "--list"]) == 0
    assert "spare [vision] disabled" in capsys.readouterr().out
    assert main(["--config", str(project_file), "--dry-run", "--only", "one", "--set", "tag=z"]) == 0
    assert "--x=z" in capsys.readouterr().out
    with pytest.raises(SystemExit) as e:
        main(["--config", str(project_file), "--set", "pipeline:zz.k=1"])
    assert e.value.code == 2
