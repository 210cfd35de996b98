"""All registered queries of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrand.plans import answers, findings, navigation, relations, reports, repository, reviews, stores, streams, testing, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = texts.QUERIES | findings.QUERIES | relations.QUERIES | repository.QUERIES | navigation.QUERIES | reviews.QUERIES | answers.QUERIES | streams.QUERIES | testing.QUERIES | reports.QUERIES | stores.QUERIES
ORACLE_SQL: dict[str, str] = texts.SQL | findings.SQL | relations.SQL | repository.SQL | navigation.SQL | reviews.SQL | answers.SQL | streams.SQL | testing.SQL | reports.SQL | stores.SQL
FLAGSHIP = "j7_tfidf_top_k"
