"""Sinks: reports and datasets, always into a new folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_report(summary: DataFrame, per_query: DataFrame, path: str, config: dict | None = None, title: str = "Run", notes: tuple[str, ...] = ()) -> str:
    """report, per_query and run_config as JSON, and the Markdown that is returned: title, notes, settings, all metrics."""
    write_json(per_query, f"{path}/per_query")
    write_json(summary, f"{path}/report")
    spark = summary.sparkSession
    if config:
        write_json(spark.createDataFrame([(k, str(v)) for k, v in sorted(config.items())], "key string, value string"), f"{path}/run_config")
    text = markdown(summary, config, title, notes)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/markdown")
    return text


def write_dataset(documents: DataFrame, queries: DataFrame, relevance: DataFrame, path: str, audit: dict[str, DataFrame] | None = None) -> None:
    """An evaluation dataset as JSON tables, with the tables of an audit beside them; each in a folder of its own."""
    for name, rows in {"documents": documents, "queries": queries, "relevance": relevance}.items():
        write_json(rows, f"{path}/{name}")
    for name, rows in (audit or {}).items():
        write_json(rows, f"{path}/audit/{name}")


def _cell(value) -> str:
    return "unavailable" if value is None else str(value).replace("|", "/").replace("\n", " ")


def markdown(summary: DataFrame, config: dict | None = None, title: str = "Run", notes: tuple[str, ...] = ()) -> str:
    """Title and notes, the settings, and every row of a summary (one a system) as a table of names and values."""
    lines = [f"# {title}", "", *(x for note in notes for x in (note, ""))]
    if config:
        lines += ["## Settings", "", "| Setting | Value |", "|---|---|", *(f"| {k} | {_cell(v)} |" for k, v in sorted(config.items())), ""]
    names = [c for c in summary.columns if c != "system"]
    for row in summary.select(*(F.col(c).cast("string") for c in summary.columns)).collect():  # one a system
        lines += [f"## Metrics{' of ' + row['system'] if 'system' in summary.columns else ''}", "", "| Metric | Value |", "|---|---|", *(f"| {c} | {_cell(row[c])} |" for c in names), ""]
    return "\n".join(lines)
