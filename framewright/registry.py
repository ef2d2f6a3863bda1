"""The library's own queries over the stand-in tables, by name, and the same as DuckDB SQL.

Floats are rounded before they are compared or ordered, so that engines agree on ties.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import stand_in as T
from framewright.functions import names
from framewright.functions.tensors import normalised, scaled
from framewright.operators import detection, diagnostics, parameters, rendering, segmentation
from framewright.plans import context, runner
from framewright.plans.ranking import ranked
from framewright.sources import images
from framewright.sources.project import Project

FLAGSHIP = "seg_valid_queries"


def _valid(s: SparkSession, d: str) -> DataFrame:
    return segmentation.valid_queries(T.queries(s, d))


def _kept(s: SparkSession, d: str) -> DataFrame:
    return segmentation.surviving(_valid(s, d), T.LEAST_AREA)


def _map(s: SparkSession, d: str) -> DataFrame:
    return segmentation.label_map(_kept(s, d), T.frames(s, d), 9)


def _stats(s: SparkSession, d: str) -> DataFrame:
    return segmentation.class_stats(_map(s, d))


def _r(*columns: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in columns]


def seg_valid_queries(s: SparkSession, d: str) -> DataFrame:
    return _valid(s, d).select("frame", "query", "class", *_r("fg_prob", "bg_prob"))


def seg_surviving(s: SparkSession, d: str) -> DataFrame:
    return _kept(s, d).select("frame", "query", "class", "area")


def seg_label_map(s: SparkSession, d: str) -> DataFrame:
    return _map(s, d).select("frame", "y", "x", "label", *_r("weight"))


def seg_class_stats(s: SparkSession, d: str) -> DataFrame:
    return _stats(s, d).select("frame", "label", "n_pixels", "cx", "cy", *_r("share_pct"))


def seg_top_classes(s: SparkSession, d: str) -> DataFrame:
    return segmentation.top_classes(_stats(s, d)).select("frame", "rank", "label", "name", "n_pixels", "caption")


def seg_coverage(s: SparkSession, d: str) -> DataFrame:
    return segmentation.coverage(_stats(s, d)).select("frame", "n_labels", *_r("coverage_pct"))


def seg_boundary(s: SparkSession, d: str) -> DataFrame:
    return segmentation.boundary(_map(s, d))


def seg_colours(s: SparkSession, d: str) -> DataFrame:
    return rendering.coloured(_map(s, d), rendering.palette(s))


def seg_blend(s: SparkSession, d: str) -> DataFrame:
    """The coloured map over a grey image of 16 times the row plus twice the column."""
    grey = T.frames(s, d).select("frame", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y")).select("frame", "y", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("x"))
    image = grey.select("frame", "y", "x", *((F.col("y") * 16 + F.col("x") * 2).alias(c) for c in "rgb"))
    return rendering.blended(image, rendering.coloured(_map(s, d), rendering.palette(s)))


def seg_counts(s: SparkSession, d: str) -> DataFrame:
    return diagnostics.query_counts(T.queries(s, d), T.LEAST_AREA)


def seg_dense_label_map(s: SparkSession, d: str) -> DataFrame:
    """Masks resized to 16 x 16 and painted by frame: the form for full-size frames. Labels as text."""
    return _dense(s, d).withColumn("labels", F.array_join("labels", ","))


def _dense(s: SparkSession, d: str) -> DataFrame:
    return segmentation.dense_label_map(_valid(s, d).withColumns({"height": F.lit(16), "width": F.lit(16)}), 4 * T.LEAST_AREA)


def seg_dense_class_stats(s: SparkSession, d: str) -> DataFrame:
    return segmentation.dense_class_stats(_dense(s, d)).select("frame", "label", "n_pixels", "cx", "cy", *_r("share_pct"))


def seg_dense_top_classes(s: SparkSession, d: str) -> DataFrame:
    return segmentation.top_classes(segmentation.dense_class_stats(_dense(s, d))).select("frame", "rank", "label", "name", "n_pixels", "caption")


def seg_dense_coverage(s: SparkSession, d: str) -> DataFrame:
    return segmentation.coverage(segmentation.dense_class_stats(_dense(s, d))).select("frame", "n_labels", *_r("coverage_pct"))


def seg_dense_boundary(s: SparkSession, d: str) -> DataFrame:
    """Which pixels of the 16 x 16 maps are boundary, as 0 and 1."""
    return segmentation.dense_boundary(_dense(s, d)).select("frame", F.array_join(F.transform("is_boundary", lambda b: b.cast("int").cast("string")), ",").alias("is_boundary"))


def det_rows(s: SparkSession, d: str) -> DataFrame:
    return detection.rows_from_rows(T.detection_rows(s, d), T.THRESHOLD, T.MOST).select("frame", "rank", "ordinal", *_r("score"), F.col("label").alias("category_id"), "category_name")


def _corners() -> list:
    return [F.col("bbox_xyxy")[k].cast("double").alias(name) for k, name in enumerate(("x1", "y1", "x2", "y2"))]


def det_postprocess(s: SparkSession, d: str) -> DataFrame:
    return detection.rows(detection.detections(T.detector_output(s, d), T.THRESHOLD, T.MOST)).select("frame", "ordinal", *_corners(), *_r("score"), "category_id", "category_name")


def det_documents(s: SparkSession, d: str) -> DataFrame:
    """Scores to six digits, so that engines write the same."""
    found = detection.detections(T.detector_output(s, d), T.THRESHOLD, T.MOST)
    plain = found.withColumn("records", F.transform("records", lambda x: x.withField("score", F.round(x["score"], 6))))
    return detection.documents(plain)


def det_label_range(s: SparkSession, d: str) -> DataFrame:
    return detection.label_range(T.detector_output(s, d))


def diag_top_classes(s: SparkSession, d: str) -> DataFrame:
    return diagnostics.top_classes(T.queries(s, d)).select("frame", "query", "rank", "class", *_r("prob"))


def diag_mask_stats(s: SparkSession, d: str) -> DataFrame:
    names_ = [f"{a}_{b}" for a in ("mask", "sigmoid") for b in ("min", "max", "mean")]
    return diagnostics.mask_stats(T.queries(s, d)).select("frame", "query", *_r(*names_), "area_native", "n_pixels")


def diag_top_queries(s: SparkSession, d: str) -> DataFrame:
    rounded = _valid(s, d).select("frame", "query", "class", *_r("fg_prob", "bg_prob"))
    return diagnostics.top_queries(rounded)


def param_listing(s: SparkSession, d: str) -> DataFrame:
    return parameters.listing(T.parameters(s, d))


def param_modules(s: SparkSession, d: str) -> DataFrame:
    return parameters.modules(T.parameters(s, d))


def param_categories(s: SparkSession, d: str) -> DataFrame:
    return parameters.categories(T.parameters(s, d))


def param_output_keys(s: SparkSession, d: str) -> DataFrame:
    return parameters.category_keys(T.parameters(s, d), "output")


def param_backbone_keys(s: SparkSession, d: str) -> DataFrame:
    return parameters.category_keys(T.parameters(s, d), "backbone")


def param_heads_segmentation(s: SparkSession, d: str) -> DataFrame:
    return parameters.heads(T.parameters(s, d), "segmentation")


def param_heads_detection(s: SparkSession, d: str) -> DataFrame:
    return parameters.heads(T.parameters(s, d), "detection")


def param_metadata(s: SparkSession, d: str) -> DataFrame:
    top = T.read(s, d, "events").select(F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 5 == 0, "model").when(F.col("event_id") % 7 == 0, "state_dict").otherwise(F.col("event_type")).alias("key"))
    return parameters.metadata(top).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def file_listing(s: SparkSession, d: str) -> DataFrame:
    """Files in path order with stem, suffix and rank over all of them."""
    files = T.listing(s, d).groupBy("path").agg(F.max("length").alias("length"))
    return ranked(files, images.path_order(F.col("path"))).select("path", F.col("rank").cast("int").alias("rank"), images.stem(F.col("path")).alias("stem"), images.suffix(F.col("path")).alias("suffix"))


def file_complete(s: SparkSession, d: str) -> DataFrame:
    named = T.listing(s, d).withColumn("path", F.regexp_replace("path", "example.net", "lvd1689m")).withColumn("length", F.col("length") * 4 * 1024 * 1024)
    return parameters.complete(named).select("path", *_r("gib"), "is_complete")


def context_overlay(s: SparkSession, d: str) -> DataFrame:
    return context.overlay(T.layers(s, d))


def context_changed(s: SparkSession, d: str) -> DataFrame:
    new = context.overlay(T.layers(s, d)).select("key", "value")
    return context.changed(new, context.overlay(T.layers(s, d).filter("layer < 6")).select("key", "value"))


def plan_overview(s: SparkSession, d: str) -> DataFrame:
    return runner.overview(T.pipelines(s, d).withColumn("ordinal", F.col("ordinal").cast("long")))


def plan_selected(s: SparkSession, d: str) -> DataFrame:
    only = T.read(s, d, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_name").alias("name"))
    return runner.selected(T.pipelines(s, d), only).select(F.col("ordinal").cast("long").alias("ordinal"), "name", "type")


def plan_steps(s: SparkSession, d: str) -> DataFrame:
    """Commands, environments and folders of the enabled pipelines' tasks, as text."""
    project = Project([], python_executable="py", accelerate_command="acc", accelerate_config=Path("/cfg/acc.yaml"), accelerate_args=["--n={tag}"], environment={"ROOT": "{base}/r"}, context={"base": "/data", "tag": "t", "nested": "{base}/n"})
    found = runner.steps(runner.selected(T.pipelines(s, d)), T.tasks(s, d), project, {"HOME": "/home/u", "KEEP": "{as it is", "A": "old"})
    changes = F.array_join(F.transform(F.array_sort(F.map_entries("changes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("pipeline_ordinal", "ordinal", "pipeline", "task", runner.shown(F.col("command")).alias("command"), F.size("command").alias("n"), changes.alias("changes"), F.col("env")["KEEP"].alias("kept"), "folder")


def pixel_inputs(s: SparkSession, d: str) -> DataFrame:
    """Embedding values as bytes of three channels, made ready for both models."""
    byte = F.floor(F.abs(F.col("v").cast("double")) * 255).cast("int")
    rgb = T.read(s, d, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("x", "v")).select("frame", F.lit(0).alias("y"), "x", byte.alias("r"), (255 - byte).alias("g"), F.expr("0").alias("b"))
    ready = {f"d{c}": scaled(F.col(c)) for c in "rgb"} | {c: normalised(F.col(c), k).cast("float") for k, c in enumerate("rgb")}
    return rgb.select("frame", "x", *(F.round(value.cast("double"), 5).alias(name) for name, value in ready.items()))


def class_names(s: SparkSession, d: str) -> DataFrame:
    ids = T.detection_rows(s, d).select(F.col("label").alias("id")).distinct()
    return ids.select("id", names.coco_name(F.col("id")).alias("coco"), names.ade20k_name(F.col("id") * 2).alias("ade20k"))


_QUERIES = (
    seg_valid_queries, seg_surviving, seg_label_map, seg_class_stats, seg_top_classes, seg_coverage, seg_boundary, seg_colours, seg_blend, seg_counts, seg_dense_label_map,
    seg_dense_class_stats, seg_dense_top_classes, seg_dense_coverage, seg_dense_boundary,
    det_rows, det_postprocess, det_documents, det_label_range, diag_top_classes, diag_mask_stats, diag_top_queries,
    param_listing, param_modules, param_categories, param_output_keys, param_backbone_keys, param_heads_segmentation, param_heads_detection, param_metadata,
    file_listing, file_complete, context_overlay, context_changed, plan_overview, plan_selected, plan_steps, pixel_inputs, class_names,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_COCO = f"""CASE WHEN {{0}} BETWEEN 1 AND 80 THEN {_list(names.COCO)}[{{0}}::BIGINT] WHEN {{0}} = 0 THEN 'person' ELSE 'class_' || {{0}} END"""
_ADE = f"""CASE WHEN {{0}} BETWEEN 0 AND 149 THEN {_list(names.ADE20K)}[{{0}}::BIGINT + 1] ELSE 'class_' || {{0}} END"""

_Q = """q AS (SELECT (vec_id // 100)::INT AS frame, (vec_id % 100)::INT AS query, list_transform(embedding, lambda v: v::DOUBLE * 20) AS logits, embedding AS mask FROM embeddings),
e AS (SELECT *, list_transform(logits, lambda v: exp(v - list_max(logits))) AS e FROM q),
p AS (SELECT *, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e),
h AS (SELECT *, list_max(p[1:63]) AS fg_prob, p[64] AS bg_prob, (list_position(p[1:63], list_max(p[1:63])) - 1)::INT AS class FROM p),
valid AS (SELECT * FROM h WHERE fg_prob > bg_prob AND fg_prob > 0.5),
areas AS (SELECT *, len(list_filter(mask, lambda v: 1 / (1 + exp(-v::DOUBLE)) > 0.5)) AS area FROM valid),
kept AS (SELECT * FROM areas WHERE area >= 30)"""
_MAP = (
    _Q
    + """,
grid AS (SELECT frame, y::INT AS y, x::INT AS x FROM (SELECT DISTINCT frame FROM q), range(8) a(y), range(8) b(x)),
px AS (SELECT frame, query, class, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, round(fg_prob / (1 + exp(-mask[i]::DOUBLE)), 9) AS w FROM kept, range(1, 65) r(i)),
best AS (SELECT frame, y, x, max(w) AS w, arg_max(class, (w, -query)) AS class FROM px WHERE w > 0 GROUP BY ALL),
map AS (SELECT g.frame, g.y, g.x, coalesce(class, 0) AS label, coalesce(w, 0.0) AS weight FROM grid g LEFT JOIN best b ON g.frame = b.frame AND g.y = b.y AND g.x = b.x),
stats AS (SELECT frame, label, count(*) AS n_pixels, floor(avg(x))::INT AS cx, floor(avg(y))::INT AS cy, count(*) / sum(count(*)) OVER (PARTITION BY frame) * 100 AS share_pct FROM map GROUP BY frame, label)"""
)
# Twice the size: each sample is 3/4 of its nearest mask value and 1/4 of the next one, by both axes; at the edges the same value twice.
_DENSE_MAP = f"""{_Q},
axis AS (SELECT i, least(greatest((i - 1) // 2, 0), 7) AS low, least(greatest((i - 1) // 2, 0) + 1, 7) AS high, CASE WHEN i = 0 THEN 0.0 WHEN i % 2 = 0 THEN 0.75 ELSE 0.25 END AS f FROM range(16) r(i)),
full_size AS (SELECT frame, query, class, fg_prob, y.i AS y, x.i AS x,
    (mask[y.low * 8 + x.low + 1] * (1 - y.f) + mask[y.high * 8 + x.low + 1] * y.f) * (1 - x.f) + (mask[y.low * 8 + x.high + 1] * (1 - y.f) + mask[y.high * 8 + x.high + 1] * y.f) * x.f AS v FROM valid, axis y, axis x),
large AS (SELECT frame, query FROM full_size GROUP BY ALL HAVING count(*) FILTER (v > 0) >= 120),
best AS (SELECT frame, y, x, arg_max(class, (fg_prob / (1 + exp(-v)), -query)) AS label FROM full_size SEMI JOIN large USING (frame, query) GROUP BY frame, y, x),
px AS (SELECT f.frame, y.i AS y, x.i AS x FROM (SELECT DISTINCT frame FROM valid) f, axis y, axis x),
map AS (SELECT px.frame, px.y, px.x, coalesce(label, 0) AS label FROM px LEFT JOIN best b ON px.frame = b.frame AND px.y = b.y AND px.x = b.x),
stats AS (SELECT frame, label, count(*) AS n_pixels, floor(avg(x))::INT AS cx, floor(avg(y))::INT AS cy, count(*) / sum(count(*)) OVER (PARTITION BY frame) * 100 AS share_pct FROM map GROUP BY frame, label)"""
_DET = """d AS (SELECT user_id AS frame, event_id AS ordinal, least(value / 500, 1.0) AS score, event_id % 92 AS label FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY ordinal) - 1 AS place FROM d),
k AS (SELECT *, score::FLOAT AS s, row_number() OVER (PARTITION BY frame ORDER BY score::FLOAT DESC, ordinal) AS rank FROM o WHERE score::FLOAT >= 0.1::FLOAT)"""
_PARAMS = """params AS (SELECT page_id AS ordinal, split_part(url, '/', 3) || '.' || ['blocks.0.attn', 'patch_embed.proj', 'decoder.layers', 'detector.head', 'mask_embed', 'classifier.fc', 'norm', 'query_embed'][page_id % 8 + 1]
    || CASE WHEN page_id % 3 = 0 THEN '.bias' ELSE '.weight' END AS key, page_id % 9 <> 0 AS is_tensor, [150, 21, 19, 80, 81, 20, 7][page_id % 7 + 1]::BIGINT AS dim, page_id % 5 = 0 AS flat FROM pages)"""


def _marks(category: str) -> str:
    return "(" + " OR ".join(f"contains(key, '{m}')" for m in parameters.CATEGORIES[category][0]) + ")"


_HEADS = f"""WITH {_PARAMS}, c AS (SELECT * FROM params WHERE ends_with(key, '.weight') AND ({' OR '.join(f"contains(key, '{m}')" for m in parameters.HEAD_MARKS)}) ORDER BY ordinal LIMIT 10)
SELECT ordinal, key, dim AS out_dim, """


def oracle_sql() -> dict[str, str]:
    colour = f"colour(label, r, g, b) AS (VALUES {_values([(i, *(int(c * 255) for c in rgb)) for i, *rgb in rendering.colours()])})"
    painted = "painted AS (SELECT m.frame, m.y, m.x, coalesce(c.r, 0) AS r, coalesce(c.g, 0) AS g, coalesce(c.b, 0) AS b FROM map m LEFT JOIN colour c ON m.label = c.label AND m.label <> 0)"
    near = " AND ".join(f"coalesce({f}(label) OVER {w} = label, false)" for w in ("r", "c") for f in ("lag", "lead"))
    layered = "l AS (SELECT length(event_type)::INT AS layer, 'user_' || user_id AS key, lpad(event_id::VARCHAR, 12, '0') AS value FROM events)"
    name = r"regexp_extract(path, '[^/]*$')"
    return {
        "seg_valid_queries": f"WITH {_Q} SELECT frame, query, class, round(fg_prob, 6) AS fg_prob, round(bg_prob, 6) AS bg_prob FROM valid",
        "seg_surviving": f"WITH {_Q} SELECT frame, query, class, area FROM kept",
        "seg_label_map": f"WITH {_MAP} SELECT frame, y, x, label, round(weight, 6) AS weight FROM map",
        "seg_dense_label_map": f"WITH {_DENSE_MAP} SELECT frame, 16 AS height, 16 AS width, string_agg(label::VARCHAR, ',' ORDER BY y, x) AS labels FROM map GROUP BY frame",
        "seg_dense_top_classes": f"""WITH {_DENSE_MAP}, t AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n_pixels DESC, label) AS rank FROM stats WHERE label <> 0)
            SELECT frame, rank::INT AS rank, label, {_ADE.format('label')} AS name, n_pixels, {_ADE.format('label')} || chr(10) || printf('%.1f', share_pct) || '%' AS caption FROM t WHERE rank <= 15""",
        "seg_dense_coverage": f"WITH {_DENSE_MAP} SELECT frame, count(*) FILTER (label <> 0) AS n_labels, round(coalesce(sum(n_pixels) FILTER (label <> 0), 0) / sum(n_pixels) * 100, 6) AS coverage_pct FROM stats GROUP BY frame",
        "seg_dense_class_stats": f"WITH {_DENSE_MAP} SELECT frame, label, n_pixels, cx, cy, round(share_pct, 6) AS share_pct FROM stats",
        "seg_dense_boundary": f"WITH {_DENSE_MAP}, edge AS (SELECT frame, y, x, label <> 0 AND NOT ({near}) AS b FROM map WINDOW r AS (PARTITION BY frame, y ORDER BY x), c AS (PARTITION BY frame, x ORDER BY y)) SELECT frame, string_agg(b::INT::VARCHAR, ',' ORDER BY y, x) AS is_boundary FROM edge GROUP BY frame",
        "seg_class_stats": f"WITH {_MAP} SELECT frame, label, n_pixels, cx, cy, round(share_pct, 6) AS share_pct FROM stats",
        "seg_top_classes": f"""WITH {_MAP}, t AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n_pixels DESC, label) AS rank FROM stats WHERE label <> 0)
            SELECT frame, rank::INT AS rank, label, {_ADE.format('label')} AS name, n_pixels, {_ADE.format('label')} || chr(10) || printf('%.1f', share_pct) || '%' AS caption FROM t WHERE rank <= 15""",
        "seg_coverage": f"WITH {_MAP} SELECT frame, count(*) FILTER (label <> 0) AS n_labels, round(coalesce(sum(n_pixels) FILTER (label <> 0), 0) / sum(n_pixels) * 100, 6) AS coverage_pct FROM stats GROUP BY frame",
        "seg_boundary": f"WITH {_MAP} SELECT frame, y, x, label, label <> 0 AND NOT ({near}) AS is_boundary FROM map WINDOW r AS (PARTITION BY frame, y ORDER BY x), c AS (PARTITION BY frame, x ORDER BY y)",
        "seg_colours": f"WITH {_MAP}, {colour}, {painted} SELECT * FROM painted",
        "seg_blend": f"WITH {_MAP}, {colour}, {painted} SELECT frame, y, x, {', '.join(f'floor(0.5 * (y * 16 + x * 2) + 0.5 * {c})::INT AS {c}' for c in 'rgb')} FROM painted",
        "seg_counts": f"WITH {_Q} SELECT q.frame, count(*) AS n_queries, count(v.query) AS n_valid, count(k.query) AS n_kept FROM q LEFT JOIN valid v USING (frame, query) LEFT JOIN kept k USING (frame, query) GROUP BY q.frame",
        "det_rows": f"""WITH d AS (SELECT user_id AS frame, event_id AS ordinal, least(value / 500, 1.0) AS score, event_id % 92 AS label FROM events),
            k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, ordinal) AS rank FROM d WHERE score >= 0.1::DOUBLE)
            SELECT frame, rank::INT AS rank, ordinal, round(score, 6) AS score, label AS category_id, {_COCO.format('label')} AS category_name FROM k WHERE rank <= 10""",
        "det_postprocess": f"WITH {_DET} SELECT frame, place::INT AS ordinal, (ordinal % 100)::DOUBLE AS x1, ((ordinal + 1) % 100)::DOUBLE AS y1, ((ordinal + 20) % 100)::DOUBLE AS x2, ((ordinal + 30) % 100)::DOUBLE AS y2, round(s::DOUBLE, 6) AS score, label AS category_id, {_COCO.format('label')} AS category_name FROM k WHERE rank <= 10",
        "det_documents": f"""WITH {_DET}, n AS (SELECT *, count(*) OVER (PARTITION BY frame) AS n FROM k),
            j AS (SELECT frame, '[' || string_agg('{{"bbox_xyxy":[' || (ordinal % 100)::DOUBLE || ',' || ((ordinal + 1) % 100)::DOUBLE || ',' || ((ordinal + 20) % 100)::DOUBLE || ',' || ((ordinal + 30) % 100)::DOUBLE || '],"score":' || round(s::DOUBLE, 6) || ',"category_id":' || label || ',"category_name":"' || {_COCO.format('label')} || '"}}', ',' ORDER BY CASE WHEN n > 10 THEN rank ELSE place END) || ']' AS json FROM n WHERE rank <= 10 GROUP BY frame)
            SELECT f.frame, coalesce(json, '[]') AS json FROM (SELECT DISTINCT frame FROM d) f LEFT JOIN j ON f.frame = j.frame""",
        "det_label_range": f"WITH {_DET} SELECT frame, min(label) AS min_label, max(label) AS max_label FROM d GROUP BY frame",
        "diag_top_classes": f"""WITH {_Q}, x AS (SELECT frame, query, (i - 1)::INT AS class, p[i] AS prob FROM p, range(1, 65) r(i) WHERE query < 10),
            t AS (SELECT *, row_number() OVER (PARTITION BY frame, query ORDER BY prob DESC, class)::INT AS rank FROM x) SELECT frame, query, rank, class, round(prob, 6) AS prob FROM t WHERE rank <= 5""",
        "diag_mask_stats": f"""WITH {_Q}, m AS (SELECT frame, query, list_transform(mask, lambda v: v::DOUBLE) AS mask, list_transform(mask, lambda v: 1 / (1 + exp(-v::DOUBLE))) AS sigmoid FROM q WHERE query < 10)
            SELECT frame, query, {', '.join(f'round(list_{f}({c}), 6) AS {c}_{n}' for c in ('mask', 'sigmoid') for f, n in (('min', 'min'), ('max', 'max'), ('avg', 'mean')))},
            len(list_filter(sigmoid, lambda v: v > 0.5)) AS area_native, len(mask) AS n_pixels FROM m""",
        "diag_top_queries": f"WITH {_Q}, r AS (SELECT frame, query, class, round(fg_prob, 6) AS fg_prob, round(bg_prob, 6) AS bg_prob FROM valid) SELECT * FROM r ORDER BY fg_prob DESC, frame, query LIMIT 20",
        "param_listing": f"WITH {_PARAMS} SELECT ordinal, key, CASE WHEN NOT is_tensor THEN '' WHEN flat THEN '(' || dim || ')' ELSE '(' || dim || ', 4)' END AS shape, CASE WHEN is_tensor THEN 'float32' ELSE 'dict' END AS dtype FROM params ORDER BY ordinal LIMIT 30",
        "param_modules": f"WITH {_PARAMS} SELECT split_part(key, '.', 1) AS module, count(*) AS n, min(ordinal) AS first_ordinal FROM params GROUP BY 1",
        "param_categories": f"WITH {_PARAMS} " + " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) AS n FROM params WHERE {_marks(c)}" for c in parameters.CATEGORIES) + " UNION ALL SELECT 'total', count(*) FROM params",
        "param_output_keys": f"WITH {_PARAMS}, f AS (SELECT * FROM params WHERE {_marks('output')} ORDER BY ordinal LIMIT 10) SELECT ordinal, key FROM f WHERE is_tensor",
        "param_backbone_keys": f"WITH {_PARAMS} SELECT ordinal, key FROM params WHERE {_marks('backbone')} ORDER BY ordinal LIMIT 5",
        "param_heads_segmentation": _HEADS + "CASE dim WHEN 150 THEN 'ADE20K' WHEN 21 THEN 'PASCAL VOC' WHEN 19 THEN 'Cityscapes' ELSE 'unknown' END AS dataset FROM c WHERE is_tensor AND NOT flat",
        "param_heads_detection": _HEADS + "CASE WHEN dim IN (80, 81) THEN 'COCO' WHEN dim IN (20, 21) THEN 'PASCAL VOC' END AS dataset FROM c WHERE is_tensor AND NOT flat",
        "param_metadata": "SELECT event_type AS key, count(*) AS n FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 GROUP BY 1",
        "file_listing": f"""WITH f AS (SELECT DISTINCT url AS path FROM pages) SELECT path, row_number() OVER (ORDER BY string_split(path, '/'))::INT AS rank,
            CASE WHEN strpos({name}, '.') > 1 THEN regexp_replace({name}, '\\.[^.]*$', '') ELSE {name} END AS stem, CASE WHEN strpos({name}, '.') > 1 THEN regexp_extract({name}, '\\.[^.]+$') ELSE '' END AS suffix FROM f""",
        "file_complete": """WITH f AS (SELECT replace(url, 'example.net', 'lvd1689m') AS path, strlen(html) * 4 * 1024 * 1024 / 1073741824.0 AS gib FROM pages)
            SELECT path, round(gib::DOUBLE, 6) AS gib, NOT (contains(path, 'lvd1689m') AND gib < 15) AS is_complete FROM f""",
        "context_overlay": f"WITH {layered} SELECT key, arg_max(value, (layer, value)) AS value, max(layer) AS layer FROM l GROUP BY key",
        "context_changed": f"""WITH {layered}, n AS (SELECT key, arg_max(value, (layer, value)) AS value FROM l GROUP BY key), o AS (SELECT key, arg_max(value, (layer, value)) AS value FROM l WHERE layer < 6 GROUP BY key)
            SELECT key, value FROM n EXCEPT SELECT key, value FROM o""",
        "plan_overview": "SELECT s_suppkey AS ordinal, s_name AS name, 'type_' || s_nationkey AS type, CASE WHEN s_acctbal > 0 THEN 'enabled' ELSE 'disabled' END AS status, NULL::VARCHAR AS description FROM supplier",
        "plan_selected": "SELECT s_suppkey AS ordinal, s_name AS name, 'type_' || s_nationkey AS type FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 3 = 0",
        "plan_steps": """WITH t AS (SELECT s_suppkey::INT AS pipeline_ordinal, p_partkey::INT AS ordinal, s_name AS pipeline, p_name AS task, p_size AS z, p_brand AS brand, 'type_' || s_nationkey AS kind, '/repo/' || s_suppkey AS repo
                FROM part JOIN supplier ON p_partkey % 50 = s_suppkey WHERE s_acctbal > 0),
            c AS (SELECT *, list_concat(
                CASE WHEN z % 2 = 0 THEN list_concat(['acc', 'launch', '--config_file', '/cfg/acc.yaml'], CASE WHEN z % 4 <> 0 THEN ['--num_processes', (z % 4)::VARCHAR] ELSE [] END, CASE WHEN z % 3 = 0 THEN ['--mixed_precision', 'bf16'] ELSE [] END, ['--n=tt', '--p=tt']) ELSE ['py'] END,
                CASE WHEN z % 5 = 0 THEN ['-m', 'pkg.tt'] WHEN z % 7 = 0 THEN ['/abs/x.py'] ELSE ['/repo/lib/run_' || kind || '.py'] END, ['--out', '/data/n/' || kind || '/' || brand, '{x}']) AS c FROM t)
            SELECT pipeline_ordinal, ordinal, pipeline, task, array_to_string(list_transform(c, lambda x: CASE WHEN regexp_full_match(x, '[A-Za-z0-9_@%+=:,./-]+') THEN x ELSE chr(39) || x || chr(39) END), ' ') AS command, len(c)::INT AS n,
                'A=' || CASE WHEN z % 2 = 0 THEN pipeline || '-' || z ELSE 'p-' || pipeline END || ';B=/data/n/' || kind || ';ROOT=/data/r' AS changes, '{as it is' AS kept,
                CASE z % 4 WHEN 0 THEN repo WHEN 1 THEN repo || '/wtt' WHEN 2 THEN '/home/u/x' ELSE '/abs/' || pipeline END AS folder FROM c""",
        "pixel_inputs": """WITH v AS (SELECT vec_id AS frame, (i - 1)::INT AS x, floor(abs(embedding[i]::DOUBLE) * 255)::INT AS v FROM embeddings, range(1, 65) r(i))
            SELECT frame, x, round((v / 255)::FLOAT::DOUBLE, 5) AS dr, round(((255 - v) / 255)::FLOAT::DOUBLE, 5) AS dg, 0.0::DOUBLE AS db, round(((v / 255 - 0.485) / 0.229)::FLOAT::DOUBLE, 5) AS r,
            round((((255 - v) / 255 - 0.456) / 0.224)::FLOAT::DOUBLE, 5) AS g, round(((0 - 0.406) / 0.225)::FLOAT::DOUBLE, 5) AS b FROM v""",
        "class_names": f"SELECT DISTINCT event_id % 92 AS id, {_COCO.format('(event_id % 92)')} AS coco, {_ADE.format('(event_id % 92 * 2)')} AS ade20k FROM events",
    }
