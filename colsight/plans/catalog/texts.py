"""TF-IDF weights and retrieval over documents."""

from __future__ import annotations

from colsight.operators.retrieval import search, tfidf_weights
from colsight.plans.catalog.base import query, rounded, table

STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "be", "as", "by", "this")
QUESTION = "The thion that rewh reed from what they are"


def _counts_sql(max_terms: int | None) -> str:
    listed = ", ".join(f"'{w}'" for w in STOP_WORDS)
    limit = f"ORDER BY sum(tf) DESC, term LIMIT {max_terms}" if max_terms else ""
    return rf"""WITH words AS (
  SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents),
tfs AS (SELECT doc, term, count(*) AS tf FROM words WHERE term NOT IN ({listed}) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY 1 {limit}),
idfs AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM dfs),
raws AS (SELECT doc, term, tf, tf * idf AS raw FROM tfs JOIN idfs USING (term)),
norms AS (SELECT doc, sqrt(sum(raw * raw)) AS norm FROM raws GROUP BY 1)"""


def _weights_sql(max_terms: int | None) -> str:
    return f"""{_counts_sql(max_terms)}
SELECT doc, term, tf, round(raw / norm, 6) AS weight FROM raws JOIN norms USING (doc)"""


@query(_weights_sql(1000))
def tfidf_weights_capped(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rounded(tfidf_weights(docs, "doc_id", "text", stop_words=STOP_WORDS, max_terms=1000), 6)


@query(_weights_sql(None))
def tfidf_weights_open(spark, sf_dir):
    """Every term, with hot and rare terms joined differently."""
    docs = table(spark, sf_dir, "documents")
    return rounded(tfidf_weights(docs, "doc_id", "text", stop_words=STOP_WORDS, max_terms=None), 6)


def _search_sql(max_terms: int | None, k: int | None, question: str = QUESTION) -> str:
    terms = [w for w in question.lower().split() if w not in STOP_WORDS]
    values = ", ".join(f"('{t}', {terms.count(t)})" for t in dict.fromkeys(terms))
    limit = f"ORDER BY round(cosine, 6) DESC, doc LIMIT {k}" if k else ""
    return f"""{_counts_sql(max_terms)},
asked AS (SELECT term, n * idf AS w FROM (VALUES {values}) q(term, n) JOIN idfs USING (term)),
products AS (
  SELECT doc, sum(raw * w) / sqrt((SELECT sum(w * w) FROM asked)) AS product FROM raws JOIN asked USING (term)
  GROUP BY 1),
scored AS (
  SELECT doc_id AS doc, coalesce(product / norm, 0.0) AS cosine FROM documents
  LEFT JOIN products ON doc_id = products.doc LEFT JOIN norms ON doc_id = norms.doc)
SELECT doc, round(cosine, 6) AS cosine, round(greatest(cosine, 0.1), 6) AS score FROM scored {limit}"""


@query(_search_sql(None, 3))
def tfidf_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rounded(search(docs, "doc_id", "text", QUESTION, stop_words=STOP_WORDS), 6)


@query(_search_sql(None, None))
def tfidf_scores_all(spark, sf_dir):
    """The score of every document over the open vocabulary."""
    docs = table(spark, sf_dir, "documents")
    return rounded(search(docs, "doc_id", "text", QUESTION, k=None, stop_words=STOP_WORDS, max_terms=None), 6)


#: Words that stand in most texts, so that their postings are long.
FREQUENT = "are by from as"


@query(_search_sql(None, 10, FREQUENT))
def tfidf_search_frequent(spark, sf_dir):
    """The ten best documents for frequent words, most of whose postings are left unread."""
    docs = table(spark, sf_dir, "documents")
    return rounded(search(docs, "doc_id", "text", FREQUENT, k=10, stop_words=STOP_WORDS), 6)
