"""Embedding of whole runs: in batches of fixed size, under one provider's version or under another's, never under both."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.library import keep

#: Chunks that go to a provider at once.
BATCH = 32


class EmbeddingFailure(Exception):
    """A provider's refusal; retryable if another provider may be asked."""

    def __init__(self, code: str, retryable: bool):
        super().__init__(code)
        self.code, self.retryable = code, retryable


@dataclass(frozen=True)
class Provider:
    """embed gets (id, text) pairs and returns (id, vector) pairs in the same order, or raises EmbeddingFailure."""

    name: str
    version: str
    dimension: int
    embed: Callable[[list[tuple[str, str]]], list[tuple[str, list[float]]]]


def checked(provider: Provider, batch: list[tuple[str, str]]) -> list[tuple[str, list[float]]]:
    vectors = list(provider.embed(batch))
    if len(vectors) != len(batch):
        raise EmbeddingFailure("embedding_count_mismatch", False)
    if [i for i, _ in vectors] != [i for i, _ in batch]:
        raise EmbeddingFailure("embedding_reference_mismatch", False)
    if any(len(v) != provider.dimension for _, v in vectors):
        raise EmbeddingFailure("embedding_dimension_mismatch", False)
    return vectors


def attempted(chunks: DataFrame, provider: Provider) -> DataFrame:
    """(run_id, id, vector, error, retryable) of chunks (run_id, ordinal, id, text): each chunk's vector, or a row with the error.

    A run's chunks come in order to one task, which sends a run's every 32 of them whatever Arrow batches they come in, holds
    no more than those, and asks no further for a run whose batch failed. What the provider raises besides EmbeddingFailure
    fails the task, which Spark tries again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        current = failed = None

        def send() -> list[tuple]:
            nonlocal failed, held
            batch, held = held, []
            if not batch or failed == current:
                return []
            try:
                return [(current, i, v, None, None) for i, v in checked(provider, batch)]
            except EmbeddingFailure as error:
                failed = current
                return [(current, None, None, error.code, error.retryable)]

        def rows(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.bool_()))], ["run_id", "id", "vector", "error", "retryable"])

        for batch in batches:
            out = []
            for run_id, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if run_id != current:
                    out += send()
                    current = run_id
                held.append((i, text))
                if len(held) == BATCH:
                    out += send()
            yield rows(out)
        yield rows(send())

    ordered = chunks.repartition("run_id").sortWithinPartitions("run_id", "ordinal", "id").select("run_id", "id", "text")
    return ordered.mapInArrow(run, "run_id string, id string, vector array<double>, error string, retryable boolean")


def embedded(chunks: DataFrame, consents: DataFrame, primary: Provider, fallback: Provider | None = None) -> tuple[DataFrame, DataFrame]:
    """Outcomes (run_id, provider, version, used_fallback, error) and vectors (run_id, id, version, vector) of runs.

    chunks: run_id, user_id, ordinal, id, text; consents: user_id, run_id, provider. A run gets all its vectors from the primary
    provider; if that fails in a way that may be tried again, all from the fallback; and else none, and the error. A run of
    several users, and one without consent for the provider that is asked, is an error that isn't tried again. Both providers'
    answers are written before they are judged, so that no chunk is sent twice for one plan.
    """

    def asked(rows: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
        """The provider's answers, and its errors (run_id, error, retryable)."""
        allowed = consents.filter(F.col("provider") == provider.name).select("user_id", "run_id").distinct()
        answers = keep(attempted(rows.join(allowed, ["user_id", "run_id"], "left_semi"), provider))
        refused = rows.join(allowed, ["user_id", "run_id"], "left_anti").select("run_id", F.lit("embedding_not_authorized").alias("error"), F.lit(False).alias("retryable")).distinct()
        return answers, answers.filter("error is not null").select("run_id", "error", "retryable").union(refused)

    users = chunks.groupBy("run_id").agg(F.count_distinct("user_id").alias("users"))
    mixed = users.filter("users > 1").select("run_id", F.lit("embedding_run_mixed_identity").alias("error"), F.lit(False).alias("retryable"))
    single = chunks.join(mixed.select("run_id"), "run_id", "left_anti")
    answers, errors = asked(single, primary)
    errors = keep(errors.union(mixed))

    def good(rows: DataFrame, bad: DataFrame, provider: Provider) -> DataFrame:
        return rows.filter("error is null").join(bad.select("run_id"), "run_id", "left_anti").select("run_id", "id", F.lit(provider.version).alias("version"), "vector")

    def told(runs: DataFrame, provider: Provider, used: bool) -> DataFrame:
        error = F.col("error") if "error" in runs.columns else F.lit(None).cast("string")
        return runs.select("run_id", F.lit(provider.name).alias("provider"), F.lit(provider.version).alias("version"), F.lit(used).alias("used_fallback"), error.alias("error"))

    runs = users.select("run_id")
    outcomes = told(runs.join(errors, "run_id", "left_anti"), primary, False)
    vectors = good(answers, errors, primary)
    if fallback is None:
        return outcomes.union(told(errors, primary, False)), vectors
    again = errors.filter("retryable").select("run_id")
    second, more = asked(single.join(again, "run_id", "left_semi"), fallback)
    more = keep(more)
    outcomes = outcomes.union(told(errors.filter("not retryable"), primary, False)).union(told(again.join(more, "run_id", "left_anti"), fallback, True)).union(told(more, fallback, True))
    return outcomes, vectors.union(good(second, more, fallback))
