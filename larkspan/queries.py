"""The registered queries: name -> (builder, DuckDB SQL)."""

from __future__ import annotations

from larkspan import catalogue
from larkspan.catalogue import collections, details, entities, graph, judging, learning, retrieval, sequences, strings

MODULES = (strings, retrieval, graph, learning, judging, collections, entities, sequences, details)
Builder = catalogue.Builder


def queries() -> dict[str, Builder]:
    return dict(catalogue.BUILDERS)


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.SQL)
