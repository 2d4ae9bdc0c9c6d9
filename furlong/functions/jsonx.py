"""JSON columns, canonical text and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furlong.functions import text


def canonical(columns: list[str]) -> Column:
    """Compact JSON with the keys in sorted order and NULLs kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def decode_map(value: Column | str, value_type: str = "string") -> Column:
    """JSON object as a map; anything else gives an empty map."""
    kind = f"map<string,{value_type}>"
    return F.coalesce(F.from_json(value, kind), F.from_json(F.lit("{}"), kind))


def feature_hash(
    features: list[str], snapshot: str, request: str, start: str, version: str
) -> Column:
    """SHA-256 over the canonical payload of one archived prediction."""
    payload = F.struct(
        F.lit(version).alias("feature_contract_version"),
        F.struct(*sorted(features)).alias("features"),
        F.col(start).cast("string").alias("race_start_at"),
        F.col(snapshot).cast("long").alias("snapshot_id"),
        F.col(request).cast("string").alias("source_request_id"),
    )
    return F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256)


def name_digest(name: Column | str) -> Column:
    """Stand-in id of an entrant known only by name."""
    folded = F.trim(F.upper(text.strip_accents(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))))
    return F.concat(F.lit("name:"), F.substring(F.sha2(folded, 256), 1, 20))


def entity_key(horse_id: Column, registry_id: Column, name: Column) -> Column:
    """horse:<id>, else registry:<id>, else a digest of the name."""
    usable = lambda c: c.isNotNull() & ~F.trim(c.cast("string")).isin("", "0")
    return (
        F.when(usable(horse_id), F.concat(F.lit("horse:"), horse_id.cast("long").cast("string")))
        .when(usable(registry_id), F.concat(F.lit("registry:"), registry_id.cast("string")))
        .otherwise(name_digest(name))
    )


def run_prefix(prediction_id: Column | str) -> Column:
    return F.substring_index(prediction_id, ":", 1)
