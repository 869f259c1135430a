"""Key figures, text chunks about a table, and the brief made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.functions.numbers import as_number
from colsight.operators import cluster as segment
from colsight.operators.clean import Cleaned
from colsight.operators.cluster import Segments
from colsight.operators.isolation import Outliers, outlier_summary
from colsight.operators.profile import categorical_stats
from colsight.operators.quantiles import exact_quantiles
from colsight.operators.retrieval import TextIndex, build_index, search_index

CHUNK_SCHEMA = "chunk_id string, title string, category string, content string, metadata map<string,string>"


def numeric_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """Mean, median, minimum, maximum per column, in the order given."""
    values = [as_number(df, n) for n in names]
    medians = exact_quantiles(df, names, [0.5])
    wide = df.agg(
        *(f(v).alias(f"{key}{i}") for i, v in enumerate(values) for key, f in
          (("mean", F.avg), ("min", F.min), ("max", F.max)))
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(i).alias("position"), F.lit(n).alias("column"), F.col(f"mean{i}").alias("mean"),
                F.lit(medians[n][0]).cast("double").alias("median"), F.col(f"min{i}").alias("minimum"),
                F.col(f"max{i}").alias("maximum"),
            )
            for i, n in enumerate(names)
        )
    )
    return wide.select(F.inline(rows))


def kpi_row(cleaned: Cleaned, outliers: Outliers | None = None) -> DataFrame:
    """The headline figures of a run in one row; figures that were not computed are null."""
    roles = cleaned.roles
    row = cleaned.report.select(
        F.col("final_rows").alias("cleaned_rows"),
        "duplicates_removed",
        F.col("n_columns"),
        *(F.lit(len(names)).cast("long").alias(f"n_{role}") for role, names in vars(roles).items()),
        "raw_score",
        "hygiene_score",
        F.col("total_imputed").alias("imputed_cells"),
    )
    if outliers is None:
        return row.select("*", F.lit(None).cast("long").alias("outliers"),
                          F.lit(None).cast("double").alias("outlier_pct"))
    summary = outlier_summary(outliers)
    return row.select(
        "*",
        summary.select("outliers").scalar().alias("outliers"),
        summary.select("outlier_pct").scalar().alias("outlier_pct"),
    )


def _lines(rows: DataFrame, order: Column, line: Column) -> DataFrame:
    """One row ``lines``: a bulleted line per row in the given order. Only tables of a few rows come here."""
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    return rows.agg(F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("- "), x["l"])), "\n").alias("lines"))


def _chunk(content: DataFrame, chunk_id: str, title: str, category: str, **metadata: Column) -> DataFrame:
    pairs = [x for key, value in metadata.items() for x in (F.lit(key), value.cast("string"))]
    return content.select(
        F.lit(chunk_id).alias("chunk_id"), F.lit(title).alias("title"), F.lit(category).alias("category"),
        F.trim("content").alias("content"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def knowledge_chunks(
    cleaned: Cleaned, pairs: DataFrame | None = None, segments: Segments | None = None,
    explained: list[float] | None = None, silhouette: float | None = None, outliers: Outliers | None = None,
) -> DataFrame:
    """Six rows of text about a table: ingestion, distributions, correlations, segments, outliers, levers.

    Each text is formatted by Spark from tables of a few rows; a part that was not computed says so instead of quoting
    a stand-in figure.
    """
    spark, roles, data = cleaned.data.sparkSession, cleaned.roles, cleaned.data
    one = spark.range(1)
    rows = F.format_string("%,d", F.col("final_rows"))
    kinds = F.lit(
        f"{len(roles.numeric)} numeric, {len(roles.categorical)} categorical, {len(roles.date)} date, "
        f"{len(roles.id_high_cardinality)} key, {len(roles.text)} text"
    )
    score = F.format_string("%.1f%%", F.col("hygiene_score"))
    ingestion = cleaned.report.withColumn(
        "content",
        F.format_string(
            "The table holds %s rows in %d columns (%s). Its hygiene score is %s. %,d duplicate rows were removed and "
            "%,d missing cells filled.",
            rows, F.col("n_columns"), kinds, score, F.col("duplicates_removed"), F.col("total_imputed"),
        ),
    )
    parts = [
        _chunk(ingestion, "ingestion", "Table size and hygiene", "hygiene", rows=F.col("final_rows"),
               cols=F.col("n_columns"), hygiene=score)
    ]

    texts = []
    if roles.numeric:
        stats = numeric_stats(data, roles.numeric)
        line = F.format_string(
            "%s: mean %,.2f, median %,.2f, range %,.2f to %,.2f", "column", "mean", "median", "minimum", "maximum"
        )
        texts.append(F.concat(F.lit("Numeric columns:\n"), _lines(stats, F.col("position"), line).scalar()))
    if roles.categorical:
        stats = categorical_stats(data, roles.categorical)
        line = F.format_string(
            "%s: %,d distinct values, most often %s (%.1f%%, %,d rows)",
            F.col("column"), F.col("n_unique"), F.coalesce("top_value", F.lit("none")),
            F.coalesce(F.col("top_share"), F.lit(0.0)) * 100, F.col("top_count"),
        )
        texts.append(F.concat(F.lit("Categories:\n"), _lines(stats, F.col("column"), line).scalar()))
    parts.append(
        _chunk(
            one.select((F.concat_ws("\n", *texts) if texts else F.lit("No columns to describe.")).alias("content")),
            "distributions", "Column distributions", "schema", numeric=F.lit(len(roles.numeric)),
            categorical=F.lit(len(roles.categorical)),
        )
    )

    if pairs is not None:
        line = F.format_string(
            "%s and %s: r = %+.3f (%s)", F.col("col1"), F.col("col2"), F.col("r"),
            F.when(F.col("r") > 0, "positive").otherwise("inverse"),
        )
        listed = _lines(pairs, -F.col("abs_r"), line).select(
            F.when(F.col("lines") == "", "No pair of columns is correlated.")
            .otherwise(F.concat(F.lit("Strongest correlations:\n"), F.col("lines")))
            .alias("content")
        )
    else:
        listed = one.select(F.lit("Correlations were not computed.").alias("content"))
    parts.append(_chunk(listed, "correlations", "Correlated columns", "correlations"))

    if segments is not None:
        named = segment.sizes(segments.rows).join(F.broadcast(segment.personas(segments.rows, segments.names)),
                                                  "cluster")
        line = F.format_string("%s: %,d rows (%.1f%%)", F.col("persona"), F.col("n"), F.col("share") * 100)
        facts = [f"{segments.k} segments"]
        if explained is not None:
            facts.append(f"two components explain {sum(explained) * 100:.1f}% of the variance")
        if silhouette is not None:
            facts.append(f"silhouette {silhouette:+.3f}")
        listed = _lines(named, F.struct(-F.col("n"), F.col("cluster")), line).select(
            F.concat(F.lit(", ".join(facts) + ":\n"), F.col("lines")).alias("content")
        )
    else:
        listed = one.select(F.lit("Segments were not computed.").alias("content"))
    parts.append(_chunk(listed, "segments", "Segments and their names", "segments",
                        k=F.lit(segments.k if segments else 0)))

    if outliers is not None:
        found = outlier_summary(outliers)
        listed = found.withColumn(
            "content",
            F.format_string(
                "An isolation forest set apart %,d rows (%.2f%%). The largest %s among them is %s.",
                F.col("outliers"), F.col("outlier_pct"), F.lit(outliers.names[0]),
                F.coalesce(F.format_string("%,.2f", F.col("extreme_value")), F.lit("none")),
            ),
        )
        parts.append(_chunk(listed, "outliers", "Isolated rows", "outliers", outliers=F.col("outliers")))
        count = found.select(F.format_string("%,d", F.col("outliers"))).scalar()
    else:
        parts.append(_chunk(one.select(F.lit("Outliers were not computed.").alias("content")), "outliers",
                            "Isolated rows", "outliers"))
        count = F.lit("0")

    levers = one.select(
        F.format_string(
            "Follow %s across segments. Compare the groups of %s. Check the %s isolated rows by hand.",
            F.lit(roles.numeric[0] if roles.numeric else "the main measure"),
            F.lit(roles.categorical[0] if roles.categorical else "the main category"), count,
        ).alias("content")
    )
    parts.append(_chunk(levers, "levers", "Where to look next", "strategy"))
    return reduce(DataFrame.unionByName, parts)


def index_chunks(chunks: DataFrame) -> TextIndex:
    """An index over title, category and text of chunks, by their id."""
    return build_index(chunks.withColumn("_all", F.concat_ws(" ", "title", "category", "content")), "chunk_id", "_all")


def cited(index: TextIndex, chunks: DataFrame, question: str, k: int | None = 3) -> DataFrame:
    """The chunks that answer a question best, with title and text: (chunk_id, title, content, cosine, score)."""
    hits = search_index(index, question, k=k)
    return hits.join(chunks, hits["doc"] == chunks["chunk_id"]).select("chunk_id", "title", "content", "cosine", "score")


def executive_brief(chunks: DataFrame) -> DataFrame:
    """One row with a narrative and the chunk texts in named columns."""
    def text(chunk_id: str) -> Column:
        return F.max(F.when(F.col("chunk_id") == chunk_id, F.col("content")))

    def fact(key: str) -> Column:
        return F.max(F.when(F.col("chunk_id") == "ingestion", F.try_element_at("metadata", F.lit(key))))

    narrative = F.format_string(
        "%s rows in %s columns were analysed; hygiene is rated %s.", fact("rows"), fact("cols"), fact("hygiene")
    )
    return chunks.agg(
        narrative.alias("narrative"), text("ingestion").alias("ingestion"), text("correlations").alias("driver"),
        text("segments").alias("segmentation"), text("outliers").alias("outlier"), text("levers").alias("strategy"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
