"""Vectors from a provider: only contents that have none are sent, in batches; an answer that does not fit its batch is a fault of that batch alone."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import list_fingerprint
from ..functions.text import is_vector
from ..session import kept, listed, publish, ship

#: Why a batch's answer is refused, and why a run is not complete.
REQUEST_FAILED, WRONG_COUNT, WRONG_INDEX, WRONG_VECTOR, INCOMPLETE = "embedding_provider_request_failed", "embedding_count_mismatch", "embedding_index_invalid", "embedding_vector_invalid", "semantic_generation_incomplete"
VECTORS = "chunk_id string, content_sha256 string, profile string, embedding array<double>, fingerprint string"
RUNS = "run_id string, status string, current long, new long, reused long, failed_batches long, requests long, error string"
_SENT = "chunk_id string, content_sha256 string, embedding array<double>, fault string, request string"


class Provider(Protocol):
    """What answers: for each text an index and a vector, in any order. It is sent to workers, and called there once a batch."""

    def embed(self, texts: list[str]) -> list[tuple[int, Sequence[float]]]: ...


class Profile(NamedTuple):
    """What makes vectors comparable: who made them, how, and how long they are."""

    provider: str
    model: str
    revision: str
    dimensions: int

    @property
    def key(self) -> str:
        return ":".join((self.provider, self.model, self.revision, str(self.dimensions)))


def checked(answer: Sequence[tuple[int, Sequence[float]]], n: int, dimensions: int) -> tuple[list[list[float]] | None, str | None]:
    """The vectors of an answer in the order of the texts, or why it is refused: each index once, each vector of the right length and finite."""
    if len(answer) != n:
        return None, WRONG_COUNT
    if sorted(i for i, _ in answer if isinstance(i, int) and not isinstance(i, bool)) != list(range(n)):
        return None, WRONG_INDEX
    vectors = [list(v) for _, v in sorted(answer, key=lambda x: x[0])]
    fine = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
    if any(len(v) != dimensions or not all(map(fine, v)) for v in vectors):
        return None, WRONG_VECTOR
    return [[float(x) for x in v] for v in vectors], None


def embedded(missing: DataFrame, provider: Provider, profile: Profile, batch: int = 64) -> DataFrame:
    """(chunk_id, content_sha256, embedding, fault, request): an answer or a fault for each of missing (chunk_id, content, content_sha256).

    A task sends its rows in batches of `batch`; a batch whose request fails, or whose answer does not fit, gives its rows the fault and no vector, and the
    others go on, so the job does not fail. `request` names the batch.
    """
    ship(missing.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    vectors, fault = checked(provider.embed(part["content"].tolist()), len(part), profile.dimensions)
                except Exception:  # whatever the provider raises is its fault, not the job's
                    vectors, fault = None, REQUEST_FAILED
                yield pd.DataFrame({
                    "chunk_id": part["chunk_id"].to_numpy(), "content_sha256": part["content_sha256"].to_numpy(), "embedding": vectors or [None] * len(part),
                    "fault": [fault] * len(part), "request": [part["chunk_id"].iloc[0]] * len(part),
                })

    return missing.select("chunk_id", "content", "content_sha256").mapInPandas(run, _SENT)


def vectors(spark: SparkSession, path: str, profile: Profile | None = None) -> DataFrame:
    """All vectors stored in a folder, of one profile or of all. Of a chunk's contents each has its own."""
    if not listed(spark, f"{path}/vectors"):
        return spark.createDataFrame([], VECTORS)
    found = spark.read.schema(VECTORS).parquet(f"{path}/vectors/*")
    return found if profile is None else found.where(F.col("profile") == profile.key)


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).json(f"{path}/runs") if listed(spark, f"{path}/runs") else spark.createDataFrame([], RUNS)


def sync(spark: SparkSession, path: str, chunks: DataFrame, provider: Provider, profile: Profile, run_id: str, batch: int = 64) -> dict:
    """Give every chunk (chunk_id, content, content_sha256) a vector of the profile; the run's summary as a dict.

    Only chunks without a vector of their very content are sent, each content once however many chunks have it. What was answered well is stored even if
    other batches failed, so the next run sends only the rest; a run after which some chunk has no vector is FAILED and says why. Chunks without an id or
    content are left out. `run_id` is new for each run.
    """
    chunks = kept(chunks.where("chunk_id IS NOT NULL AND content IS NOT NULL").select(F.col("chunk_id").cast("string").alias("chunk_id"), "content", "content_sha256").dropDuplicates(["chunk_id", "content_sha256"]), "chunks")
    have = vectors(spark, path, profile).where(is_vector(F.col("embedding"), profile.dimensions))
    missing = chunks.join(have.select("chunk_id", "content_sha256"), ["chunk_id", "content_sha256"], "left_anti")
    missing = kept(missing, "missing")
    by_content = missing.groupBy("content_sha256").agg(F.min("chunk_id").alias("chunk_id"), F.any_value("content").alias("content"))
    sent = kept(embedded(by_content, provider, profile, batch), "sent")
    print_of = list_fingerprint(F.lit(profile.key), F.col("content_sha256"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","))
    new = missing.select("chunk_id", "content_sha256").join(sent.where("fault IS NULL").select("content_sha256", "embedding"), "content_sha256")
    new = new.select("chunk_id", "content_sha256", F.lit(profile.key).alias("profile"), "embedding", print_of.alias("fingerprint"))
    new.write.parquet(f"{path}/vectors/run={run_id}")
    n, rest = chunks.count(), missing.count()
    stored = spark.read.schema(VECTORS).parquet(f"{path}/vectors/run={run_id}").count()
    s = sent.agg(F.count_distinct("request").alias("requests"), F.count_distinct(F.when(F.col("fault").isNotNull(), F.col("request"))).alias("failed"), F.min("fault").alias("fault")).first()
    current = n - rest + stored
    summary = {"run_id": run_id, "status": "COMPLETED" if current == n else "FAILED", "current": current, "new": stored, "reused": n - rest, "failed_batches": s.failed, "requests": s.requests, "error": None if current == n else s.fault or INCOMPLETE}
    publish(spark, f"{path}/runs/{run_id}.json", json.dumps(summary))
    return summary
