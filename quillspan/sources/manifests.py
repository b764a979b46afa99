"""The component manifest: TOML, an array of tables named component, to rows in the order listed."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession

COMPONENT_FIELDS = "name string, version string, kind string, target string, url string, sha256 string, size bigint, dest string, exec boolean, archive_member string, unpack_dir boolean, listed int"
#: Keys that a component must have; without one the manifest is refused, as it is a mistake of the build.
NEEDED = ("name", "kind", "url", "sha256", "size", "dest", "exec")


def manifest_rows(toml: str) -> list[dict]:
    rows = tomllib.loads(toml).get("component")
    if rows is None:
        raise ValueError("the manifest lists no component")
    for listed, row in enumerate(rows, 1):
        missing = [k for k in NEEDED if k not in row]
        if missing:
            raise ValueError(f"component {listed} lacks {', '.join(missing)}")
        if row.get("unpack_dir") and row.get("archive_member"):
            raise ValueError(f"component {listed} has both unpack_dir and archive_member")
    return [dict(r, listed=i, unpack_dir=r.get("unpack_dir", False)) for i, r in enumerate(rows, 1)]


def component_rows(spark: SparkSession, toml: str) -> DataFrame:
    """A row for each component; keys that it leaves out are null, unpack_dir false."""
    names = [f.split()[0] for f in COMPONENT_FIELDS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in manifest_rows(toml)], COMPONENT_FIELDS)
