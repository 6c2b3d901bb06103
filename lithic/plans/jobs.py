"""The library's four end-to-end jobs, each from tables to a result table.

``catalogue``: rows of all sources to the ranked, classified catalogue.
``overview``: snapshots, inventories and extractions to one row a repository.
``graph``: derived snapshots to the relationship graph's edges.
``audit``: the graph's violations of its invariants and of completeness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.operators import graph as g
from lithic.operators.catalogue import ingest
from lithic.operators.structure import overview
from lithic.views import Tables


def catalogue_job(rows: DataFrame, owner: str) -> DataFrame:
    return ingest(rows, owner)


def overview_job(t: Tables) -> DataFrame:
    counts = t("text_lines").groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"))
    return overview(t("snapshots"), t("files"), t("directories"), t("extractions"), counts)


def graph_job(t: Tables) -> DataFrame:
    return g.build(t)


def audit_job(t: Tables) -> DataFrame:
    edges, symbols = g._graph(t), g._nested(t)
    broken = g.invariants(edges, symbols, t("files"), t("directories"))
    lonely = g.completeness(edges, symbols, t("files"), t("directories"))
    return broken.unionByName(lonely.select(F.concat(F.lit("parents of "), "kind").alias("rule"), "violations"))
