"""Files: JSON arrays and lines, specs, checksummed manifests, and the written results."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privlytics.functions.tags import gold_tags, gold_violation, tags_violation
from privlytics.functions.tokens import whitespace_tokens

TASKS = ("detection", "anonymization", "leakage", "classification")


def json_rows(spark: SparkSession, path: str, *required: str, schema: str | None = None) -> DataFrame:
    """Rows of a JSON array; a missing column raises ValueError. One file is one task's work, so large inputs should be JSON lines."""
    return _checked((spark.read.schema(schema) if schema else spark.read).json(path, multiLine=True), path, required)


def json_lines(spark: SparkSession, path: str, *required: str, schema: str | None = None) -> DataFrame:
    return _checked((spark.read.schema(schema) if schema else spark.read).json(path), path, required)


def _checked(df: DataFrame, path: str, required: Iterable[str]) -> DataFrame:
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return df


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows by ``order``, columns that tell rows apart; fewer rows than that raise ValueError."""
    if (there := df.limit(n).count()) < n:
        raise ValueError(f"{n} rows are asked for, there are {there}")
    return df.orderBy(*(F.desc(c) for c in order)).limit(n)


def seeded_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows, the same ones for the same seed, in order of ``key``; all rows if n is 0 or less, or not below their number."""
    if n <= 0:
        return df.orderBy(key)
    drawn = df.withColumn("_draw", F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_draw", key).limit(n)
    return drawn.drop("_draw").orderBy(key)


def gold_tags_checked(rows: DataFrame, *keep: str) -> DataFrame:
    """(``keep``, text, tags) of rows (text, spans array<struct<start,end,label>>); one bad row fails the whole: ValueError."""
    one = rows.withColumn("_t", whitespace_tokens(F.col("text"))).withColumn("_why", gold_violation(F.col("_t"), F.col("spans")))
    tagged = one.withColumn("tags", gold_tags(F.col("_t"), F.col("spans")))
    at = tags_violation(F.col("tags"))
    why = F.when(F.col("text").isNull() | F.col("spans").isNull(), "no text or spans").otherwise(F.coalesce("_why", F.when(at.isNotNull(), "malformed tags")))
    bad = tagged.withColumn("_why", why).filter("_why is not null").select("_why", F.substring("text", 1, 80).alias("text")).first()
    if bad:
        raise ValueError(f"bad gold row: {bad._why}: {bad.text!r}")
    return tagged.select(*keep, "text", "tags")


def head_per_group(df: DataFrame, by: str, groups: list[str], n: int, *order: str) -> DataFrame:
    """The first n rows of each of the groups; a group without rows raises ValueError, a short one gives what it has."""
    wanted = df.filter(F.col(by).isin(*groups))
    there = {r[0] for r in wanted.select(by).distinct().collect()}  # no more than the groups
    if missing := [g for g in groups if g not in there]:
        raise ValueError(f"no rows for {', '.join(missing)}")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return wanted.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


@dataclass(frozen=True)
class Spec:
    """What to evaluate: a dataset, and the names of metrics."""

    name: str
    task: str
    dataset: dict
    version: int = 1
    languages: tuple[str, ...] = ()
    domain: str = "general"
    metrics: tuple[str, ...] = ()
    description: str | None = None
    extra: dict = field(default_factory=dict, compare=False)


def parse_spec(raw: dict) -> Spec:
    """A spec, or ValueError if it has no name, no dataset or an unknown task."""
    if not isinstance(raw, dict) or not raw.get("name") or not isinstance(raw.get("dataset"), dict):
        raise ValueError("a spec needs a name and a dataset")
    if raw.get("task") not in TASKS:
        raise ValueError(f"unknown task {raw.get('task')!r}")
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in Spec.__dataclass_fields__ and k != "extra"}
    return Spec(**known, extra={k: v for k, v in raw.items() if k not in Spec.__dataclass_fields__})


def load_suite(folder: str) -> list[Spec]:
    """Specs of a folder's YAML files (not of folders in it), by file name."""
    import yaml

    return [parse_spec(yaml.safe_load(p.read_text(encoding="utf-8"))) for p in sorted(Path(folder).glob("*.yaml"))]


def check_manifest(spark: SparkSession, folder: str, manifest: DataFrame, licenses: list[str]) -> DataFrame:
    """(path, problem) of a manifest (path, sha256, license): missing files, other contents, licences that are not allowed."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    files = spark.read.format("binaryFile").load(folder).select(name.alias("path"), F.sha2("content", 256).alias("found"))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "checksum").when(~F.coalesce(F.col("license").isin(*licenses), F.lit(False)), "license")
    return manifest.join(files, "path", "left").select("path", problem.alias("problem")).filter("problem is not null")


def write_board(board: DataFrame, path: str) -> None:
    """A board (models x specs rows) as one indented JSON file with its folder."""
    entries = {r["entry"]: [s.asDict(True) for s in r["specs"]] for r in board.orderBy("entry").collect()}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"schema": 3, "entries": entries}, indent=2, ensure_ascii=False), encoding="utf-8")


def write_subjects(subjects: DataFrame, path: str) -> None:
    """Subjects as Parquet, one folder for each detector."""
    subjects.write.mode("overwrite").partitionBy("detector").parquet(path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report table; more than ``limit`` rows raise ValueError rather than being cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows are no report")
    cell = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in rows)]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)
