"""Search as table functions of SQL: filtering in all tasks, and one page of what they leave.

``search_rows`` tests rows where they are and passes on, of each partition, no more than the first ``keep`` by
``ord``; ``search_page`` gathers these few, in order, and cuts the page out. Parameters are checked when a query is analysed.

    select * from search_page(table(select * from search_rows(table(pages), keyword => 'price', keep => 60)), limit => 50, offset => 10)
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, SkipRestOfInputTableException

from webloom.parameters import check

CONDITIONS = ("keyword", "url_pattern", "status_code", "has_flag", "least_words", "most_words", "least_article_words", "most_article_words", "keep")
TEXTS = ("keyword", "url_pattern", "has_flag")


def constant(name: str, argument: AnalyzeArgument | None) -> object:
    if argument is None:
        return None
    if argument.isTable or not argument.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return argument.value


def rows_of(table: AnalyzeArgument, needed: tuple[str, ...]) -> AnalyzeArgument:
    if not table.isTable:
        raise ValueError("the first argument must be a table")
    missing = [c for c in needed if c not in table.dataType.names]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return table


class SearchRows:
    """Rows of projected pages that meet all conditions; of each partition the first ``keep`` by ``ord``, all if none is given."""

    @staticmethod
    def analyze(pages: AnalyzeArgument, **conditions: AnalyzeArgument) -> AnalyzeResult:
        for name, argument in conditions.items():
            if name not in CONDITIONS:
                raise ValueError(f"no condition {name}")
            value = constant(name, argument)
            if value is not None and isinstance(value, str) != (name in TEXTS):
                raise ValueError(f"{name} must be {'a text' if name in TEXTS else 'a whole number'}")
            check("search_manifest", "words", None if name in TEXTS else value)
        return AnalyzeResult(rows_of(pages, ("ord", "url", "status_code", "title", "h1", "description", "word_count", "article_word_count", "flags")).dataType)

    def __init__(self) -> None:
        self.first: list[tuple[int, int, Row]] = []
        self.keep: int | None = None
        self.n = 0

    def eval(
        self, row: Row, keyword: str | None = None, url_pattern: str | None = None, status_code: int | None = None, has_flag: str | None = None, least_words: int | None = None,
        most_words: int | None = None, least_article_words: int | None = None, most_article_words: int | None = None, keep: int | None = None,
    ) -> Iterator[Row]:
        bounds = ((row["word_count"], least_words, most_words), (row["article_word_count"], least_article_words, most_article_words))
        text = " ".join(row[c] for c in ("title", "h1", "description") if row[c] is not None)
        good = (
            (not url_pattern or url_pattern in (row["url"] or "")) and (status_code is None or row["status_code"] == status_code) and (not keyword or keyword.lower() in text.lower())
            and (not has_flag or has_flag in (row["flags"] or ())) and all((a is None or v >= a) and (b is None or v <= b) for v, a, b in bounds)
        )
        if not good:
            return
        if keep is None:
            yield row
            return
        # a heap of the first rows so far, the last of them on top
        self.n += 1
        entry = (-row["ord"], -self.n, row)
        if len(self.first) < keep:
            heapq.heappush(self.first, entry)
        elif self.first and entry > self.first[0]:
            heapq.heapreplace(self.first, entry)

    def terminate(self) -> Iterator[Row]:
        for _, _, row in self.first:
            yield row


class SearchPage:
    """Rows ``offset`` to ``offset + limit - 1`` of a table by ``ord``; what comes after is not read."""

    @staticmethod
    def analyze(found: AnalyzeArgument, limit: AnalyzeArgument | None = None, offset: AnalyzeArgument | None = None) -> AnalyzeResult:
        check("search_manifest", "limit", constant("limit", limit))
        check("search_manifest", "offset", constant("offset", offset))
        return AnalyzeResult(rows_of(found, ("ord",)).dataType, withSinglePartition=True, orderBy=[OrderingColumn("ord")])

    def __init__(self) -> None:
        self.at = 0

    def eval(self, row: Row, limit: int | None = 20, offset: int | None = 0) -> Iterator[Row]:
        at, self.at = self.at, self.at + 1
        start = offset or 0
        stop = start + (20 if limit is None else limit)
        if at >= stop:
            raise SkipRestOfInputTableException("the page is full")
        if at >= start:
            yield row


def register(spark: SparkSession) -> None:
    """Makes ``search_rows`` and ``search_page`` known to the session's SQL."""
    spark.udtf.register("search_rows", udtf(SearchRows))
    spark.udtf.register("search_page", udtf(SearchPage))
