"""Task files: lists of tasks as JSON, read, filtered and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TASK = """struct<key: string, id: string, prompt: string, env_id: string, env_key: string, created_at: string, version: string, data_id: string, data_version: string,
    env_variables: variant, verifier_func: string, verifier_code: string, verifier_sha: string, verifier_id: string, verifier: struct<code: string, sha256: string, verifier_id: string>,
    metadata: variant, output_json_schema: variant, team_id: string, project_key: string>"""


def read_tasks(spark: SparkSession, path: str, **filters: str | list[str] | None) -> DataFrame:
    """Tasks of files that hold one task a line, or a list of tasks or an object with a list `tasks`, in one file.

    Names that were used for the same thing are one: id for key, env_key for env_id, verifier_code or a
    nested verifier's code for verifier_func. A missing verifier_id is the nested one, that of the metadata,
    or the key. filters: columns to a value or to a list of values, null for no filter.
    """
    document = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    first = F.substring(F.ltrim("v"), 1, 1)
    listed = F.when(first == "[", F.from_json("v", f"array<{_TASK}>")).otherwise(F.from_json("v", f"struct<tasks: array<{_TASK}>>").tasks)
    by_line = F.transform(F.filter(F.split("v", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, _TASK))
    tasks = document.select(F.explode(F.coalesce(listed, by_line)).alias("t")).select("t.*").where("coalesce(key, id) is not null")
    given = lambda name: F.when(~F.is_variant_null(name), F.col(name)).alias(name)
    of_metadata = F.try_variant_get("metadata", "$.verifier.verifier_id", "string")
    out = tasks.select(
        F.coalesce("key", "id").alias("key"), "prompt", F.coalesce("env_id", "env_key").alias("env_id"), "created_at", "version", "data_id", "data_version", given("env_variables"),
        F.coalesce("verifier_func", "verifier_code", "verifier.code").alias("verifier_func"), F.coalesce("verifier_id", "verifier.verifier_id", of_metadata, "key", "id").alias("verifier_id"),
        F.coalesce("verifier_sha", "verifier.sha256", F.lit("")).alias("verifier_sha"), F.try_variant_get("metadata", "$.verifier_runtime_version", "string").alias("verifier_runtime_version"), given("metadata"), given("output_json_schema"), "team_id", "project_key",
    )
    for name, value in filters.items():
        if value is not None:
            out = out.where(F.col(name).isin(value if isinstance(value, list) else [value]))
    return out


def write_tasks(tasks: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as there are partitions; read_tasks reads them back."""
    tasks.write.mode("overwrite").json(path)
