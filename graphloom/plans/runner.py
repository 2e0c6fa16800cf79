"""Named queries over parameter files, timed case by case."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.graph import PropertyGraph
from graphloom.operators import algorithms, text
from graphloom.plans import intelligence, interactive
from graphloom.sources.graph_store import load
from graphloom.sources.params import cases
from graphloom.storage import staged


def _bfs(g: PropertyGraph, person: int) -> DataFrame:
    return algorithms.bfs_all_labels(g, "person", person)


def _page_rank(g: PropertyGraph, iterations: int, damping: float) -> DataFrame:
    return algorithms.page_rank_all_labels(g, iterations, damping)


NAMED: dict[str, Callable[..., DataFrame]] = {
    "bfs": _bfs, "serial_bfs": _bfs, "page_rank": _page_rank, "serial_page_rank": _page_rank, "khops": interactive.khops, "khop_any_label": algorithms.khop_any_label,
    "ic1": interactive.ic1, "ic2": interactive.ic2, "ic5": interactive.ic5, "ic9": interactive.ic9, "ic10": interactive.ic10, "ic13": interactive.ic13,
    "bi2": intelligence.bi2, "bi3": intelligence.bi3, "bi10": intelligence.bi10, "bi12": intelligence.bi12, "bi16": intelligence.bi16, "bi19": intelligence.bi19,
}


def startup(spark: SparkSession, directory: str) -> tuple[PropertyGraph, float]:
    """The saved graph and the seconds that loading took."""
    began = time.perf_counter()
    graph = load(spark, directory)
    return graph, time.perf_counter() - began


def run(graph: PropertyGraph, query: str, lines: list[str], max_num: int | None = None, header: bool | None = None, sep: str | None = None) -> tuple[list[DataFrame], dict[str, float]]:
    """A result for each case, computed and written once, and milliseconds: prepare, running, average, total."""
    began = time.perf_counter()
    todo = cases(query.removeprefix("serial_"), lines, max_num, header, sep)
    ready = time.perf_counter()
    out = [staged(NAMED[query](graph, **case), f"result-{query}") for case in todo]
    done = time.perf_counter()
    ms = lambda s: round(s * 1000, 3)
    return out, {"cases": len(todo), "prepare": ms(ready - began), "running": ms(done - ready), "avg_running": ms((done - ready) / max(1, len(todo))), "total": ms(done - began)}


def append_timing(spark: SparkSession, path: str, query: str, timing: dict[str, float]) -> None:
    """One line for a run, added to those at ``path``."""
    line = " ".join([query, *(f"{k}={v}" for k, v in timing.items())])
    spark.createDataFrame([(line,)], "line string").coalesce(1).write.mode("append").text(path)


def show(df: DataFrame, path: str, header: bool = False) -> None:
    """A result as ``|``-separated text, with the names of its columns if ``header``; without rows the line EMPTY TABLE."""
    if df.isEmpty():
        df.sparkSession.createDataFrame([("EMPTY TABLE",)], "line string").coalesce(1).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").option("sep", "|").option("header", header).csv(path)


def text_command(df: DataFrame, doc_id: str, column: str, line: str) -> DataFrame:
    """``count <pattern>``, ``locate <pattern>`` or ``extract <start> <length>`` over a text column."""
    name, _, rest = line.strip().partition(" ")
    if name == "count" and rest:
        return text.count(df, column, rest)
    if name == "locate" and rest:
        return text.locate(df, doc_id, column, rest)
    if name == "extract" and len(rest.split()) == 2:
        return text.extract(df, doc_id, column, *map(int, rest.split()))
    raise ValueError(f"not a text command: {line!r}")
