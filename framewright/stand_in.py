"""The driver's tables in the shapes that the operators take. They stand in for shape and semantics; they are no vision data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.plans.context import ENTRIES, entries

#: Masks are 8 x 8, so a query needs this many pixels instead of the production value.
LEAST_AREA = 30
THRESHOLD, MOST = 0.1, 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentor queries from embeddings: 100 to a frame, logits 20 times the vector, the same vector as an 8 x 8 mask."""
    return read(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 100").cast("int").alias("frame"), (F.col("vec_id") % 100).cast("int").alias("query"),
        F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 20).alias("logits"), F.col("embedding").alias("mask"), F.lit(8).alias("mask_h"), F.lit(8).alias("mask_w"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries(spark, sf_dir).select("frame").distinct().withColumns({"height": F.lit(8), "width": F.lit(8)})


def detection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection an event: frame = user, score = value / 500 up to 1, label = event_id % 92."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("frame"), F.col("event_id").alias("ordinal"), F.least(F.col("value") / 500, F.lit(1.0)).alias("score"), (F.col("event_id") % 92).alias("label"))


def detector_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one row of parallel arrays a frame, in event order."""
    one = F.struct("ordinal", F.col("score").cast("float").alias("s"), F.col("label").alias("l"))
    held = detection_rows(spark, sf_dir).groupBy("frame").agg(F.sort_array(F.collect_list(one)).alias("a"))
    box = lambda x: F.array(*(((x["ordinal"] + k) % 100).cast("float") for k in (0, 1, 20, 30)))
    return held.select("frame", F.transform("a", box).alias("boxes"), F.transform("a", lambda x: x["s"]).alias("scores"), F.transform("a", lambda x: x["l"]).alias("labels"))


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter catalogue from pages: the first label of the host, then a part that page_id picks."""
    parts = ("blocks.0.attn", "patch_embed.proj", "decoder.layers", "detector.head", "mask_embed", "classifier.fc", "norm", "query_embed")
    dims = (150, 21, 19, 80, 81, 20, 7)
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), (F.col("page_id") % k).cast("int"))
    tensor = F.col("page_id") % 9 != 0
    two = F.array(pick(dims, len(dims)).cast("bigint"), F.lit(4).cast("bigint"))
    return read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("ordinal"),
        F.concat(F.substring_index(F.substring_index("url", "/", 3), "/", -1), F.lit("."), pick(parts, len(parts)), F.when(F.col("page_id") % 3 == 0, ".bias").otherwise(".weight")).alias("key"),
        tensor.alias("is_tensor"),
        F.when(tensor, F.when(F.col("page_id") % 5 == 0, F.slice(two, 1, 1)).otherwise(two)).alias("shape"),
        F.when(tensor, "float32").otherwise("dict").alias("dtype"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("length"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context layers from events: the length of the type's name is the layer, the user the key."""
    return read(spark, sf_dir, "events").select(F.char_length("event_type").alias("layer"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("value"))


def pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pipelines (PIPELINES), enabled with a positive balance; the pipeline's own values use the project's."""
    key = F.col("s_suppkey").cast("string")
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("ordinal"), F.col("s_name").alias("name"), F.concat(F.lit("type_"), F.col("s_nationkey").cast("string")).alias("type"), F.concat(F.lit("/repo/"), key).alias("repo_path"),
        (F.col("s_acctbal") > 0).alias("enabled"), F.lit(None).cast("string").alias("description"), entries({"B": "{out}", "A": "p-{pipeline}"}).alias("environment"),
        entries({"out": "{nested}/{pipeline_type}", "tag": "{tag}{tag}"}).alias("context"), F.array(F.lit("--p={tag}")).alias("accelerate_args"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tasks (TASKS) of the first 50 suppliers; the part's size picks the kind of script, launcher and folder."""
    size = F.col("p_size")
    own = F.array(F.struct(F.lit("A").alias("key"), F.concat(F.lit("{pipeline}-"), size.cast("string")).alias("value"))).cast(ENTRIES)
    return read(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 50).cast("int").alias("pipeline_ordinal"), F.lit(None).cast("string").alias("pipeline"), F.col("p_partkey").cast("int").alias("ordinal"), F.col("p_name").alias("name"),
        F.when(size % 5 == 0, "pkg.{tag}").when(size % 7 == 0, "/abs/{missing}x.py").otherwise("../lib/./run_{pipeline_type}.py").alias("script"),
        F.array(F.lit("--out"), F.concat(F.lit("{out}/"), F.col("p_brand")), F.lit("{{x}}")).alias("args"), (size % 2 == 0).alias("use_accelerate"), F.nullif(size % 4, F.lit(0)).alias("num_processes"),
        F.when(size % 3 == 0, "bf16").alias("mixed_precision"), F.when(size % 2 == 0, own).otherwise(F.array().cast(ENTRIES)).alias("env"),
        F.when(size % 4 == 1, "w{tag}").when(size % 4 == 2, "~/x").when(size % 4 == 3, "/abs/{pipeline}").alias("working_dir"), (size % 5 == 0).alias("python_module"), F.lit(None).cast("string").alias("comment"),
    )
