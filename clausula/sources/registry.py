"""Named sources and targets, so that a bundle's dialect or a contract's target is looked up and not coded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausula.sources import bundles, markdown

Reader = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Names to functions; a given table can stand in for the default one."""

    def __init__(self, entries: dict[str, Callable] | None = None):
        self.entries = dict(entries or {})

    def register(self, name: str, function: Callable, replace: bool = False) -> None:
        if name in self.entries and not replace:
            raise KeyError(f"{name} is registered already")
        self.entries[name] = function

    def select(self, name: str) -> Callable:
        if name not in self.entries:
            raise KeyError(f"unknown: {name}; known: {', '.join(sorted(self.entries))}")
        return self.entries[name]


def assert_columns(df: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """df, if it has the columns that its kind promises."""
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"{name} gives no {', '.join(lost)}")
    return df


def _json(spark: SparkSession, path: str) -> DataFrame:
    return bundles.parsed(bundles.read_documents(spark, path))


def _markdown(spark: SparkSession, path: str) -> DataFrame:
    return markdown.properties(bundles.read_documents(spark, path))


FRONTENDS = Registry({"json": _json, "markdown": _markdown})
PROMISED = {"json": ("doc_id", "ir", "well_formed"), "markdown": ("doc_id", "name", "type_ref")}


def run_frontend(spark: SparkSession, dialect: str, path: str, registry: Registry = FRONTENDS) -> DataFrame:
    return assert_columns(registry.select(dialect)(spark, path), PROMISED.get(dialect, ("doc_id",)), dialect)


def _canonical(df: DataFrame, path: str) -> None:
    bundles.write_canonical(df, path)


BACKENDS = Registry({"canonical-json": _canonical, "parquet": lambda df, path: df.write.parquet(path), "csv": lambda df, path: df.write.option("header", True).csv(path), "orc": lambda df, path: df.write.orc(path)})
