"""Ingestion: sources run one by one to materials, merged with those that are there."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.storage import written
from trellis.operators.tables import first_wins, merge_by_key

log = logging.getLogger(__name__)

MATERIAL = "id string, topic_id string, source string, url string, title string, content string"
#: A source takes topics (topic) and returns materials.
Source = Callable[[DataFrame], DataFrame]


def ingest(topics: DataFrame, sources: dict[str, Source], existing: DataFrame, parallel: int = 4) -> tuple[DataFrame, dict[str, str]]:
    """(materials, failures): existing materials (MATERIAL) after those of all sources, by id: of two
    sources that give one id the later one counts, of a source's own rows the first by url, title and
    content. Rows without id are dropped. Sources run side by side, each written before it is merged; one
    that fails, at planning or in a task, gives no rows: it is logged and named in failures."""
    from concurrent.futures import ThreadPoolExecutor

    columns = [c.split()[0] for c in MATERIAL.split(", ")]

    def run(item: tuple[str, Source]) -> DataFrame | str:
        name, source = item
        try:
            return written(source(topics).select(columns).filter("id is not null"))
        except PySparkException as e:
            log.warning("source %s failed: %s", name, e)
            return str(e)
        except Exception as e:
            log.warning("source %s failed", name, exc_info=True)
            return f"{type(e).__name__}: {e}"

    failures, out = {}, existing.select(columns)
    with ThreadPoolExecutor(parallel) as pool:
        found = list(pool.map(run, sources.items()))
    for name, rows in zip(sources, found, strict=True):
        if isinstance(rows, str):
            failures[name] = rows
        else:
            out = merge_by_key(out, first_wins(rows, ["id"], ["url", "title", "content"]), ["id"])
    return written(out), failures


def material_totals(materials: DataFrame) -> DataFrame:
    """(topic_id, source, rows, chars) of materials."""
    return materials.groupBy("topic_id", "source").agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"))
