"""Correlation, segments, projection and outliers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from colsight.functions.numbers import col
from colsight.operators import cluster as seg
from colsight.operators.correlation import top_pairs
from colsight.operators.isolation import find_outliers, outlier_points, outlier_samples, outlier_summary
from colsight.operators.silhouette import silhouette
from colsight.plans.catalog.base import query, rounded, table
from colsight.plans.catalog.charts import CORRELATED

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIR = ["l_quantity", "l_extendedprice"]


def _lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query("SELECT col1, col2, round(r, 6) AS r, round(abs(r), 6) AS abs_r FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{CORRELATED[i]}' AS col1, '{CORRELATED[j]}' AS col2, "
    f"corr({CORRELATED[i]}, {CORRELATED[j]}) AS r FROM lineitem"
    for i, j in combinations(range(len(CORRELATED)), 2)
) + ") ORDER BY abs(r) DESC, i, j LIMIT 4")
def corr_top_pairs(spark, sf_dir):
    return rounded(top_pairs(_lineitem(spark, sf_dir), CORRELATED), 6)


@query("""WITH m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt,
stddev_pop(l_tax) AS st FROM lineitem)
SELECT l_returnflag, round(avg((l_quantity - mq) / sq), 6) AS mean_quantity,
round(avg((l_tax - mt) / st), 6) AS mean_tax, round(stddev_pop((l_quantity - mq) / sq), 6) AS std_quantity,
round(stddev_pop((l_tax - mt) / st), 6) AS std_tax FROM lineitem, m GROUP BY 1""")
def standardised_moments(spark, sf_dir):
    scaled = seg.standardise(_lineitem(spark, sf_dir), ["l_quantity", "l_tax"])
    return rounded(
        scaled.groupBy("l_returnflag").agg(
            F.avg("l_quantity").alias("mean_quantity"), F.avg("l_tax").alias("mean_tax"),
            F.stddev_pop("l_quantity").alias("std_quantity"), F.stddev_pop("l_tax").alias("std_tax"),
        ),
        6,
    )


# Two standardised columns have the components (1, s) and (1, -s) over sqrt(2), s being the sign of their correlation.
PCA_SQL = """WITH m AS (
  SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp,
         stddev_pop(l_extendedprice) AS sp, sign(corr(l_quantity, l_extendedprice)) AS s,
         abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem),
projected AS (
  SELECT l_returnflag, l_linestatus, ((l_quantity - mq) / sq + s * (l_extendedprice - mp) / sp) / sqrt(2) AS pca1,
         ((l_quantity - mq) / sq - s * (l_extendedprice - mp) / sp) / sqrt(2) AS pca2 FROM lineitem, m)"""


@query(f"{PCA_SQL} SELECT l_returnflag, round(pca1, 4) AS pca1, round(pca2, 4) AS pca2 FROM projected")
def pca_points(spark, sf_dir):
    projected = seg.project(_lineitem(spark, sf_dir), PAIR).rows
    return rounded(projected.select("l_returnflag", "pca1", "pca2"))


@query(f"""{PCA_SQL} SELECT 1 AS component, round((1 + r) / 2, 6) AS explained FROM m
UNION ALL SELECT 2, round((1 - r) / 2, 6) FROM m""")
def pca_explained(spark, sf_dir):
    explained = seg.project(_lineitem(spark, sf_dir), PAIR).explained
    return rounded(
        spark.createDataFrame(list(enumerate(explained, 1)), "component int, explained double"), 6
    )


@query(f"""{PCA_SQL} SELECT l_linestatus, round(avg(pca1), 6) AS pca1, round(avg(pca2), 6) AS pca2
FROM projected GROUP BY 1""")
def pca_centroids(spark, sf_dir):
    return rounded(seg.centroids(seg.project(_lineitem(spark, sf_dir), PAIR).rows, "l_linestatus"), 6)


@query("""SELECT l_returnflag, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lineitem), 6)
AS share FROM lineitem GROUP BY 1""")
def group_sizes(spark, sf_dir):
    return rounded(seg.sizes(_lineitem(spark, sf_dir), "l_returnflag"), 6)


@query("SELECT l_returnflag, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in FEATURES)
       + " FROM lineitem GROUP BY 1")
def group_profiles(spark, sf_dir):
    return rounded(seg.profiles(_lineitem(spark, sf_dir), FEATURES, "l_returnflag"))


def _persona_sql() -> str:
    names = ["value", "user_id"]
    deviations = " UNION ALL ".join(
        f"SELECT event_type, {i} AS i, '{n}' AS name, avg({n}) AS mean, "
        f"(avg({n}) - (SELECT avg({n}) FROM events)) / (abs((SELECT avg({n}) FROM events)) + 1e-5) AS dev "
        "FROM events GROUP BY 1"
        for i, n in enumerate(names)
    )
    text = (
        "CASE WHEN abs(mean) >= 100 THEN format('{:t,}', CAST(round(mean) AS BIGINT)) "
        "WHEN abs(mean) >= 1 THEN printf('%.1f', mean) ELSE printf('%.2f', mean) END"
    )
    low_text = (
        "CASE WHEN abs(mean) >= 100 THEN format('{:t,}', CAST(round(mean) AS BIGINT)) ELSE printf('%.2f', mean) END"
    )
    return f"""WITH d AS ({deviations}),
hi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY dev DESC, i) AS rn FROM d)
       WHERE rn = 1),
lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY dev, i) AS rn FROM d)
       WHERE rn = 1)
SELECT hi.event_type, CASE WHEN hi.dev > 0.15 THEN 'High ' || hi.name || ' (Avg ' || hi.t || ')'
  WHEN lo.dev < -0.15 THEN 'Low ' || lo.name || ' (Avg ' || lo.t || ')'
  ELSE 'Moderate ' || hi.name || ' Cohort' END AS persona
FROM (SELECT *, {text} AS t FROM hi) hi JOIN (SELECT *, {low_text} AS t FROM lo) lo
  ON hi.event_type = lo.event_type"""


@query(_persona_sql())
def personas_by_event_type(spark, sf_dir):
    """Naming by given groups, which SQL can check."""
    return seg.personas(table(spark, sf_dir, "events"), ["value", "user_id"], "event_type")


def _segments(spark, sf_dir):
    return seg.segments(_lineitem(spark, sf_dir), FEATURES, 4, partitions=spark.sparkContext.defaultParallelism)


PLANTED_SQL = """
WITH planted AS (
  SELECT l_orderkey % 4 AS g, CAST(1000 * (l_orderkey % 4) AS DOUBLE) + l_quantity AS x,
         CAST(500 * ((l_orderkey % 4) % 2) + l_linenumber AS DOUBLE) AS y FROM lineitem),
scale AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM planted),
z AS (SELECT g, x, y, (x - mx) / sx AS zx, (y - my) / sy AS zy FROM planted, scale),
middle AS (SELECT g, avg(zx) AS cx, avg(zy) AS cy FROM z GROUP BY g)"""


def _planted(spark, sf_dir):
    """Line items moved into four far groups, so the best segments are known."""
    group = F.col("l_orderkey") % 4
    rows = table(spark, sf_dir, "lineitem").select(
        (1000.0 * group + F.col("l_quantity")).alias("x"), (500.0 * (group % 2) + F.col("l_linenumber")).alias("y")
    )
    return seg.segments(rows, ["x", "y"], 4)


@query(PLANTED_SQL + """
SELECT CAST(g AS INTEGER) AS cluster, count(*) AS n, round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y,
       round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM z), 6) AS share
FROM z GROUP BY g""")
def kmeans_planted(spark, sf_dir):
    """Size, share and profile of each segment."""
    rows = _planted(spark, sf_dir).rows
    joined = seg.sizes(rows).join(seg.profiles(rows, ["x", "y"]), "cluster")
    return joined.select(
        "cluster", "n", F.round("x", 4).alias("mean_x"), F.round("y", 4).alias("mean_y"), F.round("share", 6).alias("share")
    )


@query(PLANTED_SQL + """
SELECT 4 AS k, (SELECT count(*) FROM z) AS n,
       round((SELECT sum((zx - cx) ** 2 + (zy - cy) ** 2) FROM z JOIN middle USING (g)), 3) AS inertia""")
def kmeans_planted_inertia(spark, sf_dir):
    found = _planted(spark, sf_dir)
    rows = found.rows.count()
    return spark.createDataFrame([(found.k, rows, round(found.inertia, 3))], "k int, n long, inertia double")


@query(PLANTED_SQL + """
SELECT CAST(g AS INTEGER) AS cluster, round(x, 4) AS x, round(y, 4) AS y FROM z""")
def kmeans_planted_points(spark, sf_dir):
    """Every row with its segment."""
    return rounded(_planted(spark, sf_dir).rows.select("cluster", "x", "y"))


@query()
def kmeans_sizes(spark, sf_dir):
    return seg.sizes(_segments(spark, sf_dir).rows)


@query()
def kmeans_profiles(spark, sf_dir):
    found = _segments(spark, sf_dir)
    return rounded(seg.profiles(found.rows, found.names))


@query()
def kmeans_personas(spark, sf_dir):
    found = _segments(spark, sf_dir)
    return seg.personas(found.rows, found.names)


@query()
def kmeans_summary(spark, sf_dir):
    """k, inertia and silhouette (squared Euclidean over all rows)."""
    found = _segments(spark, sf_dir)
    rows = [(found.k, found.inertia, seg.silhouette_squared(found.rows))]
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double")


@query()
def kmeans_points(spark, sf_dir):
    """Every row with its segment, the segment's name and its projection."""
    found = _segments(spark, sf_dir)
    projected = seg.project(found.rows, found.names, found.scaling).rows
    named = projected.join(F.broadcast(seg.personas(found.rows, found.names)), "cluster")
    return named.select("cluster", "persona", "pca1", "pca2", *(col(n) for n in found.names))


@query()
def kmeans_centroids(spark, sf_dir):
    found = _segments(spark, sf_dir)
    return seg.centroids(seg.project(found.rows, found.names, found.scaling).rows)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "label", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64))
    )


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (
  SELECT a.vec_id, a.label, b.label AS other, count(*) AS n, sum(list_distance(a.v, b.v) ** 2) AS total
  FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
ab AS (
  SELECT vec_id, min(CASE WHEN label <> other THEN total / n END) AS b,
         coalesce(min(CASE WHEN label = other THEN total / n END), 0) AS a FROM d GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 4) AS silhouette FROM ab""")
def silhouette_labels(spark, sf_dir):
    """Silhouette of given labels over all vectors, one pass over per-label sums instead of all pairs."""
    from pyspark.ml.feature import VectorAssembler

    wide = _vectors(spark, sf_dir)
    rows = VectorAssembler(inputCols=wide.columns[1:], outputCol="features").transform(wide)
    value = seg.silhouette_squared(rows.select("features", "label"), "label")
    return rounded(spark.createDataFrame([(value,)], "silhouette double"))


def _silhouette_sql(points: str) -> str:
    """All pairs of distinct points (g, v, n: cluster, coordinates, rows), each counted as often as its rows."""
    return f"""{points},
sums AS (SELECT a.g, a.v, a.n, b.g AS h, sum(b.n * list_distance(a.v, b.v)) AS s FROM points a, points b GROUP BY 1, 2, 3, 4),
held AS (SELECT g AS h, sum(n) AS size FROM points GROUP BY 1),
sides AS (
  SELECT g, v, n, max(CASE WHEN g = h THEN s / greatest(1, size - 1) END) AS a, min(CASE WHEN g <> h THEN s / size END) AS b
  FROM sums JOIN held USING (h) GROUP BY 1, 2, 3)
SELECT round(sum(n * (b - a) / greatest(a, b)) / sum(n), 6) AS silhouette, CAST(sum(n) AS BIGINT) AS n_rows FROM sides"""


@query(_silhouette_sql("""WITH points AS (
  SELECT label AS g, CAST(embedding AS DOUBLE[]) AS v, count(*) AS n FROM embeddings GROUP BY 1, 2)"""))
def silhouette_euclidean_labels(spark, sf_dir):
    """Euclidean silhouette of given labels over all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("features"))
    found = silhouette(vectors, "label")
    return rounded(spark.createDataFrame([(found.value, found.n_rows)], "silhouette double, n_rows long"), 6)


@query(_silhouette_sql(f"""{PLANTED_SQL}, points AS (SELECT g, [zx, zy] AS v, count(*) AS n FROM z GROUP BY 1, 2)"""))
def silhouette_euclidean_planted(spark, sf_dir):
    """Euclidean silhouette of the segments of all moved line items."""
    found = silhouette(_planted(spark, sf_dir).rows)
    return rounded(spark.createDataFrame([(found.value, found.n_rows)], "silhouette double, n_rows long"), 6)


@query()
def silhouette_euclidean_segments(spark, sf_dir):
    """Euclidean silhouette of the line items' segments, with the bound of its error."""
    found = silhouette(_segments(spark, sf_dir).points, partitions=spark.sparkContext.defaultParallelism)
    return spark.createDataFrame([(found.value, found.error, found.n_rows)], "silhouette double, error double, n_rows long")


@query()
def kmeans_embeddings(spark, sf_dir):
    """Segments of 64-dimensional vectors by size."""
    wide = _vectors(spark, sf_dir)
    return seg.sizes(seg.segments(wide, wide.columns[1:], 4, restarts=3).rows)


def _outliers(spark, sf_dir):
    return find_outliers(_lineitem(spark, sf_dir), FEATURES, partitions=spark.sparkContext.defaultParallelism)


@query()
def iforest_flags(spark, sf_dir):
    """Every row with its score and flag."""
    return _outliers(spark, sf_dir).rows


@query()
def anomaly_summary(spark, sf_dir):
    return outlier_summary(_outliers(spark, sf_dir))


@query()
def anomaly_samples(spark, sf_dir):
    return outlier_samples(_outliers(spark, sf_dir))


@query()
def outlier_scatter(spark, sf_dir):
    return outlier_points(_outliers(spark, sf_dir), "l_quantity", "l_extendedprice")
