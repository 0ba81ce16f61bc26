"""All registered queries of the page-reading and contribution operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkfold.plans import documents, jobs, pages, scalars, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for part in (pages, scalars, documents, jobs, streams):
    QUERIES |= part.QUERIES
    ORACLE |= part.ORACLE

flagship = pages.flagship
