"""Rule files: JSON documents of rules, read into one checked table, a row for each profile and key.

A file is an object of a profile's rules, nested or with dotted keys: {"profile": "strict", "seo": {"keyword_occurrences":
{"severity": "critical"}, "occurrences": {"MEDIUM": {"max": 12}}}}. Without `profile` it is the profile "default". What a
file doesn't name stays as it is. Keys are those of settings.known(); anything else, or a value of the wrong kind, is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import settings

SCHEMA = "profile string, key string, kind string, value string, file string, error string"


def _leaves(found: object, at: str = "") -> Iterator[tuple[str, object]]:
    if isinstance(found, dict):
        for k, v in found.items():
            yield from _leaves(v, f"{at}.{k}" if at else str(k))
    else:
        yield at, found


def fault(kind: str | None, value: object) -> str | None:
    """What is wrong with a value of a kind; null if nothing is."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    good = {
        "severity": value in settings.SEVERITIES, "switch": isinstance(value, bool), "number": number and value >= 0,
        "limit": value is None or (number and value >= 0 and value == int(value)), None: False,
    }[kind]
    return None if good else "unknown key" if kind is None else f"not a {kind}"


def parsed(content: str) -> list[dict]:
    """profile, key, kind, value and error of each rule of a file."""
    known = settings.known()
    try:
        found = json.loads(content)
        if not isinstance(found, dict):
            raise TypeError("a rule file is an object")
    except (ValueError, TypeError) as e:
        return [{"profile": None, "key": None, "kind": None, "value": None, "error": f"{type(e).__name__}: {e}"}]
    profile = found.pop("profile", "default")
    out = []
    for key, value in _leaves(found):
        kind = known.get(key, (None,))[0]
        shown = "none" if value is None else str(value).lower() if isinstance(value, bool) else str(int(value)) if kind == "limit" and not fault(kind, value) else str(value)
        out.append({"profile": str(profile), "key": key, "kind": kind, "value": shown, "error": fault(kind, value)})
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (profile, key, kind, value, file, error) of all rule files under a path; errors are rows too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in ("profile", "key", "kind", "value", "file", "error")])
        for batch in batches:
            rows = [r | {"file": name} for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in parsed(content)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").mapInArrow(run, SCHEMA)


def table(rows: DataFrame, shown: int = 20) -> DataFrame:
    """read() rows, or any (profile, key, value), as a map of rules for each profile; raises if a row is wrong or two files differ.

    A profile has some 200 keys at most, so its map is small.
    """
    if "error" in rows.columns:
        wrong = rows.where(F.col("error").isNotNull()).select("file", "key", "value", "error").limit(shown).collect()
        if wrong:
            raise ValueError("wrong rules: " + "; ".join(f"{r.file}: {r.key} = {r.value}: {r.error}" for r in wrong))
    values = rows.groupBy("profile", "key").agg(F.min("value").alias("value"), F.max("value").alias("other"))
    twice = values.where("value <> other").limit(shown).collect()
    if twice:
        raise ValueError("rules with several values: " + "; ".join(f"{r.profile}: {r.key}" for r in twice))
    return values.groupBy("profile").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("rules"))


def with_rules(df: DataFrame, found: DataFrame, profile: str = "profile", column: str = "rules") -> DataFrame:
    """df -> also the rules of each row's profile; one without rules has an empty map. Spark broadcasts the few profiles if their maps are small."""
    known = found.select(F.col("profile").alias("_of"), F.col("rules").alias("_found_rules"))
    joined = df.join(known, F.col(profile) == F.col("_of"), "left")
    return joined.withColumn(column, F.coalesce("_found_rules", F.create_map().cast("map<string,string>"))).drop("_of", "_found_rules")
