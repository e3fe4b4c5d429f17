"""Helper responses (one JSON text each) as entity tables, by from_json alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENTITY = (
    "kind string, name string, line int, end_line int, indent int, parent string, docstring string, parameters array<string>, decorators array<string>, calls array<string>, call_sequence array<string>, "
    "visibility string, bases array<string>, declaration_kind string, type_parameters array<string>, type_constraints array<string>, resolved_calls array<string>, symbol_id string, is_async boolean"
)
_FIELDS = ",".join(":".join(c.strip().split(" ")) for c in _ENTITY.split(", "))
RESPONSE = f"contract_version string, request_id string, ok boolean, ir struct<language:string,entities:array<struct<{_FIELDS}>>,imports:array<string>>, error struct<kind:string,message:string,backend_id:string,retryable:boolean>"
KINDS = ("class", "function", "method")
VISIBILITIES = ("public", "protected", "private", "unspecified")


def responses(raw: DataFrame, version: str | None = None) -> DataFrame:
    """raw (module_id, request_id, response) with the parsed `r` and `failure`: null, or why the response is refused."""
    parsed = raw.withColumn("r", F.from_json("response", RESPONSE))
    bad_kind = F.exists("r.ir.entities", lambda e: ~e["kind"].isin(*KINDS))
    failure = (
        F.when(F.col("r").isNull() | F.col("r.ok").isNull(), F.lit("protocol_error"))
        .when(F.col("r.request_id") != F.col("request_id"), F.lit("protocol_error"))
        .when(F.lit(version is not None) & (F.col("r.contract_version") != F.lit(version or "")), F.lit("version_mismatch"))
        .when(~F.col("r.ok"), F.coalesce("r.error.kind", F.lit("failure")))
        .when(bad_kind, F.lit("protocol_error"))
    )
    return parsed.withColumn("failure", failure)


def entities(parsed: DataFrame) -> DataFrame:
    """Entity rows of accepted responses; a missing end line is the line, an unknown visibility is unspecified."""
    rows = parsed.where("failure is null").select("module_id", F.posexplode("r.ir.entities").alias("ordinal", "e")).select("module_id", "ordinal", "e.*")
    return rows.withColumn("end_line", F.coalesce("end_line", "line")).withColumn("visibility", F.when(F.col("visibility").isin(*VISIBILITIES), F.col("visibility")).otherwise(F.lit("unspecified")))


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.where("failure is null").select("module_id", F.posexplode("r.ir.imports").alias("pos", "ref"))
