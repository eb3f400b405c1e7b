"""Model presets and request checks, as literal tables and decision expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (id, model id, needs a GPU, English only).
PRESETS = [
    ("auto", "__auto__", False, False),
    ("fast", "onnx-community/whisper-tiny_timestamped", False, False),
    ("balanced", "onnx-community/whisper-base_timestamped", False, False),
    ("quality", "onnx-community/whisper-large-v3-turbo_timestamped", True, False),
    ("fast_en", "onnx-community/distil-small.en_timestamped", False, True),
]
MAX_SPEAKERS = 64


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset_id string, model_id string, gpu_only boolean, english_only boolean")


def models(spark: SparkSession) -> DataFrame:
    """The models that can be asked for; all come with the program, so all are ready."""
    return presets(spark).where("model_id <> '__auto__'").select("model_id", F.lit(True).alias("ready"))


def with_availability(requests: DataFrame, status: DataFrame) -> DataFrame:
    """``requests`` (model_id) with available: whether ``status`` (model_id, ready) has the model ready; no model needs none."""
    ready = status.where("ready").select("model_id").distinct().withColumn("_ready", F.lit(True))
    return requests.join(ready, "model_id", "left").withColumn("available", F.col("model_id").isNull() | F.coalesce("_ready", F.lit(False))).drop("_ready")


def is_english(language) -> Column:
    return F.lower(F.col(language) if isinstance(language, str) else language).isin("english", "en")


def auto_preset(gpu, memory_gib, cores, task, language) -> Column:
    """Unknown memory counts as 4 when asking for a weak machine, as 0 when asking for a strong one."""
    gpu, memory, cores, task = (F.col(c) if isinstance(c, str) else c for c in (gpu, memory_gib, cores, task))
    weak = ~gpu & ((F.coalesce(memory, F.lit(4.0)) <= 4) | (cores <= 4))
    strong = gpu & (F.coalesce(memory, F.lit(0.0)) >= 8) & (cores >= 8)
    return F.when(task == "translate", "balanced").when(weak & is_english(language), "fast_en").when(weak, "fast").when(strong, "quality").otherwise("balanced")


def resolve_models(requests: DataFrame) -> DataFrame:
    """``requests`` (preset_id, gpu, memory_gib, cores, task, language) with resolved_preset, model_id, device and language.

    A preset that does not exist is an error.
    """
    language = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("auto"))
    wanted = F.when(F.col("preset_id") == "auto", auto_preset("gpu", "memory_gib", "cores", "task", language)).otherwise(F.col("preset_id"))
    wanted = F.when((wanted == "quality") & ~F.col("gpu"), "balanced").otherwise(wanted)
    wanted = F.when((wanted == "fast_en") & ((F.col("task") == "translate") | ~is_english(language)), "balanced").otherwise(wanted)
    ids = {p: m for p, m, _, _ in PRESETS if p != "auto"}
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in ids.items() for x in pair]), F.col("resolved_preset"))
    model = F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("no such preset: "), F.coalesce("resolved_preset", F.lit("null")))))
    device = F.when(F.col("gpu"), "webgpu").otherwise("wasm")
    return requests.withColumn("resolved_preset", wanted).withColumns({"model_id": model, "device": device, "language": language})


def valid_speaker_count(count, backend: bool = False) -> Column:
    """1 to 64 where a user enters it; behind that, 0 or nothing stands for automatic."""
    c = F.col(count) if isinstance(count, str) else count
    if backend:
        return c.isNull() | c.between(0, MAX_SPEAKERS)
    return F.coalesce((c == F.floor(c)) & c.between(1, MAX_SPEAKERS), F.lit(False))


def cluster_count(count) -> Column:
    c = F.col(count) if isinstance(count, str) else count
    return F.when(F.coalesce(c, F.lit(0)) > 0, c).otherwise(F.lit(-1))


def valid_threshold(x) -> Column:
    c = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.coalesce((c > 0) & ~F.isnan(c) & (c < float("inf")), F.lit(False))
