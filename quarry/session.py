"""Session settings shared by every entry point."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Fix the time zone and let local Python workers import this package.

    On a cluster the package is shipped with ``--py-files``; the path added here
    only helps workers that see the same checkout.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(p for p in (ROOT, env.get("PYTHONPATH", "")) if p)
    return spark


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of literals whose size the optimizer knows, so that it can broadcast it; ``schema`` as in createDataFrame."""
    if not rows:
        return spark.createDataFrame([], schema)
    columns = [part.strip().split(" ", 1) for part in schema.split(",")]
    names = [f"c{i}" for i in range(len(columns))]
    values = ", ".join(f"({', '.join(f':v{r}_{i}' for i in range(len(columns)))})" for r in range(len(rows)))
    casts = ", ".join(f"cast({n} as {kind}) as `{name}`" for n, (name, kind) in zip(names, columns, strict=True))
    return spark.sql(f"select {casts} from values {values} as t({', '.join(names)})", args={f"v{r}_{i}": v for r, row in enumerate(rows) for i, v in enumerate(row)})


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
