"""What a user calls: jobs, transcripts, speakers, exports, over a set of tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import config, text
from .operators import align, cues, export, store


@dataclass(frozen=True)
class Workspace:
    """Tables of sources, transcripts, jobs and names; every change gives a new workspace."""

    spark: SparkSession
    sources: DataFrame
    transcripts: DataFrame
    jobs: DataFrame
    names: DataFrame

    def register(self) -> None:
        """The tables as temporary views, for SQL."""
        for name in ("sources", "transcripts", "jobs", "names"):
            getattr(self, name).createOrReplaceTempView(name)

    def create_jobs(self, requests: DataFrame) -> DataFrame:
        """Where each request (request_id, source_id, source_type, recipe) leads."""
        return store.new_jobs(store.route_jobs(requests.withColumn("language", text.normalise_language("language")), self.transcripts, self.sources))

    def jobs_view(self) -> DataFrame:
        return store.hydrate_jobs(self.jobs, self.sources)

    def persist(self, new: DataFrame) -> Workspace:
        return replace(self, **store.persist_transcripts(self.transcripts, self.jobs, self.names, new))

    def rename(self, new: DataFrame) -> Workspace:
        """Valid names (source_id, speaker_key, display_name, seq) replace older ones; others are left out."""
        checked = new.withColumn("_n", text.validated_name("display_name")).where("_n.error is null").withColumn("display_name", F.col("_n.value")).drop("_n")
        return replace(self, names=store.upsert_names(self.names, checked))

    def speaker_names(self) -> DataFrame:
        return store.speaker_names(self.names)

    def expire(self, now: Column) -> Workspace:
        return replace(self, sources=store.expire_audio(self.sources, now).drop("expired"))

    def models(self) -> DataFrame:
        return config.models(self.spark)

    def health(self) -> DataFrame:
        return self.jobs.agg(F.lit(0).alias("queued"), F.lit(0).alias("transcriptions"), F.count_if(F.col("status") == "downloading").alias("active_downloads"))


consolidate = cues.consolidate
align_speakers = align.assign_speakers
export_captions = export.export
