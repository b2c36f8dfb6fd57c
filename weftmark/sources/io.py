"""Readers and writers for the job's tables.

Readers apply the fixed schemas (no inference pass over the data, malformed JSON
rows become nulls rather than failing the job). Writers put successes and
failures in separate folders (the failure folder is the quarantine) and never
collect anything to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COMPLETION, PAGE, REQUEST, RESPONSE
from .commits import write_batch


def _read(spark: SparkSession, path: str, schema, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "json":
        reader = reader.option("mode", "PERMISSIVE")
    return reader.format(fmt).load(path)


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Requests with the fixed schema; defaults are applied by ``read_urls.request_defaults``."""
    return _read(spark, path, REQUEST, fmt)


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured responses (final response after redirects, headers map, body bytes)."""
    return _read(spark, path, RESPONSE, fmt)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: rendered pages; ``page_id`` must be unique."""
    return _read(spark, path, PAGE, fmt)


def read_completions(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Model answers captured by an external scoring job, one per ``prompt_id``."""
    return _read(spark, path, COMPLETION, fmt)


def write_results(results: DataFrame, errors: DataFrame, path: str, fmt: str = "parquet", batch: str | int = 0) -> None:
    """S4 + S5: successes under ``path/results``, failures under ``path/errors`` (quarantine), committed together.

    ``fmt='json'`` writes the JSON envelopes one per line (``json`` column as text). Writing a batch
    again replaces both sides of it. Read with ``commits.read_committed``.
    """
    write_batch(results, errors, path, batch, fmt)


def write_prompts(prompts: DataFrame, path: str, mode: str = "overwrite", options: dict | None = None) -> None:
    """The model-call payloads as JSON lines ``{"prompt_id", "host", "payload"}``; ``options`` go into each payload."""
    from ..operators.summary import prompt_payload

    prompt_payload(prompts, options).select(F.to_json(F.struct("prompt_id", "host", "payload")).alias("value")).write.mode(mode).text(path)
