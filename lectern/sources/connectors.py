"""Connectors: where documents of a source come from, over tables and files that Spark reads.

A connector searches, lists what one creator published, and fetches metadata and texts by id. Ids that are not there are
left out; nothing found is an empty table; a source that cannot be read raises when it is read."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import plain_html
from lectern.operators.filters import like_any


class Connector(Protocol):
    def search(self, query: str, limit: int | None = None) -> DataFrame: ...

    def list_creator_items(self, creator, since=None, limit: int | None = None) -> DataFrame: ...

    def fetch_metadata(self, ids: list | DataFrame | None) -> DataFrame: ...

    def fetch_text(self, ids: list | DataFrame | None) -> DataFrame: ...


_CONNECTORS: dict[str, Connector] = {}


def register(source_type: str, connector: Connector) -> None:
    _CONNECTORS[source_type] = connector


def connector_for(source_type: str) -> Connector:
    """KeyError for a type that nothing is registered for."""
    return _CONNECTORS[source_type]


def _of(rows: DataFrame, id_col: str, ids: list | DataFrame | None) -> DataFrame:
    if ids is None:
        return rows
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")
    return rows.filter(F.col(id_col).isin(ids)) if ids else rows.filter(F.lit(False))


class Stored:
    """A source's items in a table: an id, a creator, a time (or number) to walk by, columns to search in, and the text."""

    def __init__(self, rows: DataFrame, id_col: str, creator: str, at: str, searched: tuple[str, ...], text: str):
        self.rows = rows.withColumn("id", F.col(id_col))
        self.creator, self.at, self.searched, self.text = creator, at, searched, text

    def _first(self, rows: DataFrame, limit: int | None) -> DataFrame:
        return rows if limit is None else rows.orderBy(F.desc(self.at), "id").limit(limit)

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """Items that hold every word of the query."""
        found = self.rows if query.strip() else self.rows.filter(F.lit(False))
        for word in query.split():
            found = found.filter(like_any(word, *self.searched))
        return self._first(found, limit)

    def list_creator_items(self, creator, since=None, limit: int | None = None) -> DataFrame:
        """All that a creator published, or what came after a time."""
        rows = self.rows.filter(F.col(self.creator) == creator)
        return self._first(rows if since is None else rows.filter(F.col(self.at) > F.lit(since)), limit)

    def fetch_metadata(self, ids: list | DataFrame | None) -> DataFrame:
        return _of(self.rows, "id", ids).drop(self.text) if self.text not in self.searched else _of(self.rows, "id", ids)

    def fetch_text(self, ids: list | DataFrame | None) -> DataFrame:
        return _of(self.rows, "id", ids).select("id", F.col(self.text).alias("text")).filter(F.trim("text") != "")


class Articles:
    """Web pages as articles: title and plain text out of the HTML; a page without a text has none to fetch."""

    def __init__(self, pages: DataFrame, id_col: str, url: str, html: str):
        self.pages, self.id, self.url, self.html = pages, id_col, url, html

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        found = self.pages.filter(like_any(query, self.url, self.html))
        return found if limit is None else found.orderBy(self.id).limit(limit)

    def list_creator_items(self, creator, since=None, limit: int | None = None) -> DataFrame:
        """The pages of one host."""
        host = F.regexp_extract(self.url, "^[a-z]+://([^/?#]+)", 1)
        rows = self.pages.filter(host == creator)
        return rows if limit is None else rows.orderBy(self.id).limit(limit)

    def fetch_metadata(self, ids: list | DataFrame | None) -> DataFrame:
        title = F.trim(F.regexp_extract(self.html, "(?is)<title[^>]*>(.*?)</title>", 1))
        return _of(self.pages, self.id, ids).select(self.id, self.url, title.alias("title")).filter("title <> ''")

    def fetch_text(self, ids: list | DataFrame | None) -> DataFrame:
        return _of(self.pages, self.id, ids).select(self.id, plain_html(self.html).alias("text")).filter("text <> ''")
