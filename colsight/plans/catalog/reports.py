"""Key figures, knowledge chunks and the brief."""

from __future__ import annotations

from dataclasses import replace

from colsight.operators.clean import clean
from colsight.operators.cluster import project, segments, silhouette_squared
from colsight.operators.correlation import top_pairs
from colsight.operators.isolation import find_outliers
from colsight.operators.report import cited, executive_brief, index_chunks, knowledge_chunks, kpi_row
from colsight.plans.catalog.base import DIRTY_ROLES, dirty_orders, query, rounded, table
from colsight.plans.catalog.cleaning import REPORT_SQL
from colsight.plans.diagnose import diagnose
from colsight.session import materialize


@query(f"""{REPORT_SQL}
SELECT final_rows AS cleaned_rows, duplicates_removed, n_columns, CAST(2 AS BIGINT) AS n_numeric,
       CAST(2 AS BIGINT) AS n_categorical, CAST(1 AS BIGINT) AS n_date, CAST(1 AS BIGINT) AS n_id_high_cardinality,
       CAST(0 AS BIGINT) AS n_text, round(raw_score, 6) AS raw_score,
       round(least(100.0, greatest(85.0, raw_score)), 6) AS hygiene_score, total_imputed AS imputed_cells
FROM report""")
def kpis_orders(spark, sf_dir):
    cleaned = clean(dirty_orders(spark, sf_dir), DIRTY_ROLES)
    return rounded(kpi_row(cleaned).drop("outliers", "outlier_pct"), 6)


def _chunks(spark, sf_dir):
    """Chunks of a whole run over the orders, segments and outliers included."""
    cleaned = clean(dirty_orders(spark, sf_dir), DIRTY_ROLES)
    data, names = materialize(cleaned.data, "clean"), DIRTY_ROLES.numeric
    cleaned = replace(cleaned, data=data)
    found = segments(data, names, restarts=3)
    projection = project(found.rows, names, found.scaling)
    outliers = find_outliers(data, names)
    return materialize(
        knowledge_chunks(
            cleaned, top_pairs(data, names), found, projection.explained, silhouette_squared(found.rows), outliers
        ),
        "chunks",
    )


@query()
def knowledge_chunks_orders(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", "title", "category", "content")


@query()
def executive_brief_orders(spark, sf_dir):
    return executive_brief(_chunks(spark, sf_dir))


@query()
def retrieve_chunks_orders(spark, sf_dir):
    """Chunks that answer a question, with their titles and texts."""
    chunks = _chunks(spark, sf_dir)
    return rounded(cited(index_chunks(chunks), chunks, "which columns are correlated"), 6)


@query()
def diagnosis_events(spark, sf_dir):
    """The whole run over a table, as its key figures."""
    return diagnose(table(spark, sf_dir, "events"), restarts=3).kpis
