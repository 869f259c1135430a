import pytest

from colsight.plans.ask import ask
from colsight.plans.diagnose import diagnose
from tests.fixtures import sales

CHUNKS = ["correlations", "distributions", "ingestion", "levers", "outliers", "segments"]


@pytest.fixture(scope="module")
def run(spark):
    return diagnose(sales(spark), k=3, restarts=2)


def test_key_figures(run):
    row = run.kpis.first()
    assert (row["cleaned_rows"], row["duplicates_removed"], row["imputed_cells"]) == (20, 1, 2)
    assert (row["n_numeric"], row["n_categorical"], row["n_date"], row["n_id_high_cardinality"]) == (3, 2, 1, 1)
    assert row["outliers"] == 1 and row["outlier_pct"] == 5.0
    flagged = run.outliers.rows.where("is_outlier").collect()
    assert [r["Transaction_ID"] for r in flagged] == ["TXN-2000"]


def test_chunks_and_brief(run):
    texts = {r["chunk_id"]: r["content"] for r in run.chunks.collect()}
    assert sorted(texts) == CHUNKS
    assert "20 rows in 7 columns" in texts["ingestion"] and "98.4%" in texts["ingestion"]
    assert "Revenue: mean 1,811.07, median 610.00, range 89.99 to 15,000.00" in texts["distributions"]
    assert "Region: 4 distinct values, most often North (30.0%, 6 rows)" in texts["distributions"]
    assert texts["correlations"].split("\n")[1] == "- Revenue and Quantity: r = +0.982 (positive)"
    assert texts["segments"].startswith("3 segments, two components explain")
    assert "set apart 1 rows (5.00%). The largest Revenue among them is 15,000.00" in texts["outliers"]
    brief = run.brief.first()
    assert brief["n_chunks"] == 6 and brief["driver"] == texts["correlations"]
    assert brief["narrative"] == "20 rows in 7 columns were analysed; hygiene is rated 98.4%."


def test_questions_cite_chunks(run):
    answer = ask(run.data, run.roles, "tell me about isolated outliers", index=run.index)
    assert answer.intent == "retrieval"
    assert answer.citations.first()["doc"] == "outliers"


def test_tables_without_numbers(spark):
    tiny = spark.createDataFrame([(10, "Alpha"), (20, "Beta"), (30, "Gamma")], "ColA int, ColB string")
    run = diagnose(tiny)
    assert run.pairs is None and run.segments is None and run.outliers is None
    row = run.kpis.first()
    assert row["cleaned_rows"] == 3 and row["outliers"] is None
    texts = {r["chunk_id"]: r["content"] for r in run.chunks.collect()}
    assert sorted(texts) == CHUNKS and texts["outliers"] == "Outliers were not computed."
