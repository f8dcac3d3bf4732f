"""Web search as a table: an engine that answers in JSON, asked from the tasks.

`web_search` is a data source whose rows are the results of queries; queries and categories
reach it as filters or as options, and each query is a partition. `searched` asks the queries
of a DataFrame, which may be very many.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

# Results of a query, seconds to wait for them.
RESULTS, WAIT = 10, 15
SCHEMA = "query string, categories string, position int, title string, url string, snippet string, image string, thumbnail string, source_engine string, score double"


def _rows(endpoint: str, query: str, categories: str | None, limit: int, strict: bool) -> list[tuple]:
    """A query's results in the engine's order; none for an engine that fails or answers nonsense, unless strict."""
    asked = {"q": query, "format": "json", "pageno": 1} | ({"categories": categories} if categories else {})
    try:
        with urlopen(Request(f"{endpoint.rstrip('/')}/search?{urlencode(asked)}", headers={"Accept": "application/json"}), timeout=WAIT) as answer:
            items = json.load(answer).get("results") or []
    except Exception:
        if strict:
            raise
        return []
    rows = []
    for item in items[:limit]:
        text = {k: str(item.get(k) or "") for k in ("title", "url", "content", "engine", "img_src", "thumbnail_src")}
        image = text["img_src"] or text["thumbnail_src"] or (text["url"] if categories == "images" else "")
        image = f"https:{image}" if image.startswith("//") else image
        score = item.get("score")
        score = float(score) if isinstance(score, (int, float)) and not isinstance(score, bool) else None
        rows.append((query, categories, len(rows) + 1, text["title"].strip(), text["url"], text["content"], image or None, text["thumbnail_src"] or image or None, text["engine"], score))
    return rows


def searched(queries: DataFrame, endpoint: str, categories: str | None = None, limit: int = RESULTS, at_once: int = 4, strict: bool = False) -> DataFrame:
    """The results (SCHEMA) of the queries of a DataFrame (query): each different one is asked once, so many at a time a task.

    Null and blank queries have no results. The engine's failures are empty results, or the
    job's failure if strict. Results aren't kept: a table that is read twice asks twice, so
    write it (scratch.materialize) before it is used again.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                answers = pool.map(lambda q: _rows(endpoint, q, categories, limit, strict), batch["query"])
                rows = [r for rows in answers for r in rows]
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")]).astype({"position": "int32", "score": "float64"})

    distinct = queries.select(F.col("query").cast("string").alias("query")).where("trim(query) <> ''").distinct()
    return distinct.mapInPandas(ask, SCHEMA)


class _Query(InputPartition):
    def __init__(self, query: str, categories: str | None):
        self.query, self.categories = query, categories


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.queries = json.loads(options["queries"]) if "queries" in options else None
        self.categories = options.get("categories")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equalities on query and on categories; hands back the others, and a second one on the same column."""
        taken = set()
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            values = ([f.value] if isinstance(f, EqualTo) else list(f.value)) if name else []
            if name == "query" and "query" not in taken and self.queries is None:
                self.queries = [v for v in values if v is not None]
            elif name == "categories" and len(values) == 1 and "categories" not in taken and self.categories is None:
                self.categories = values[0]
            else:
                yield f
                continue
            taken.add(name)

    def partitions(self) -> list[InputPartition]:
        if self.queries is None:
            raise ValueError("web_search needs its queries: a filter on query, or the option queries")
        return [_Query(q, self.categories) for q in dict.fromkeys(self.queries) if q.strip()] or [_Query("", None)]

    def read(self, partition: _Query) -> Iterator[tuple]:
        if partition.query:
            yield from _rows(self.options["endpoint"], partition.query, partition.categories, int(self.options.get("limit", RESULTS)), self.options.get("strict", "false") == "true")


class WebSearch(DataSource):
    """Results of a search engine; options endpoint, queries (a JSON list), categories, limit, strict.

    Filters on query and categories reach the engine.
    """

    @classmethod
    def name(cls) -> str:
        return "web_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "endpoint" not in self.options:
            raise ValueError("web_search needs the option endpoint")
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets filters reach Python sources, which this one needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WebSearch)
