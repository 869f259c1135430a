"""From a raw table to roles, clean data, models and a report."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from colsight.functions.dates import DATE_FORMATS
from colsight.operators.clean import Cleaned, clean
from colsight.operators.cluster import Projection, Segments, project, segments, silhouette_squared
from colsight.operators.correlation import top_pairs
from colsight.operators.isolation import Outliers, find_outliers
from colsight.operators.profile import Roles, detect_roles
from colsight.operators.report import executive_brief, index_chunks, knowledge_chunks, kpi_row
from colsight.operators.retrieval import TextIndex
from colsight.session import materialize


@dataclass(frozen=True)
class Diagnosis:
    """Everything a run found; tables are lazy, models and roles are small."""

    roles: Roles
    cleaned: Cleaned
    data: DataFrame
    pairs: DataFrame | None
    segments: Segments | None
    projection: Projection | None
    silhouette: float | None
    outliers: Outliers | None
    kpis: DataFrame
    chunks: DataFrame
    brief: DataFrame
    index: TextIndex


def diagnose(
    df: DataFrame, *, k: int = 4, contamination: float = 0.05, seed: int = 42, restarts: int = 10,
    policy: str = "median_mode", order: str = "hygiene_first", formats=DATE_FORMATS,
) -> Diagnosis:
    """Run the whole sequence. Roles come from the raw table and hold for everything after cleaning.

    The clean table is written once; every model and figure reads the columns it needs from there.
    """
    roles = detect_roles(df, formats=formats)
    cleaned = clean(df, roles, policy=policy, order=order, formats=formats)
    data = materialize(cleaned.data, "clean")
    stored = replace(cleaned, data=data)
    names = roles.numeric
    pairs = top_pairs(data, names) if len(names) >= 2 else None
    found = segments(data, names, k, seed=seed, restarts=restarts) if len(names) >= 2 else None
    projection = project(found.rows, names, found.scaling) if found else None
    silhouette = silhouette_squared(found.rows) if found else None
    outliers = find_outliers(data, names, contamination=contamination, seed=seed) if names else None
    explained = projection.explained if projection else None
    chunks = materialize(knowledge_chunks(stored, pairs, found, explained, silhouette, outliers), "chunks")
    return Diagnosis(
        roles, stored, data, pairs, found, projection, silhouette, outliers, kpi_row(stored, outliers), chunks,
        executive_brief(chunks), index_chunks(chunks),
    )
