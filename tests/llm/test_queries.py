"""The queries of the package against SQL, or against what must hold of their results."""

import pytest

from korpora.llm import queries
from tests.compare import same

#: Of queries without SQL: conditions that every row fulfils, and the table with as many rows (of distinct ids), if there is one.
HOLDS = {
    "p2_found": ("issue IN ('missing', 'wrong', 'mixed') AND lang IN ('en', 'de', 'fr', 'es', 'it')", None),
    "p2_pages": ("confidence BETWEEN 0 AND 1 AND ambiguous = (confidence < 0.6) AND forall(segments, s -> s.lang <> lang AND s.first_line <= s.last_line AND s.sentences > 0)", None),
    "p3_found": ("field = 'text' AND line_no >= 1 OR field = 'description' AND line_no = 1", None),
    "p3_articles": ("text IS NOT NULL AND (description IS NULL OR description <> '')", "docs"),
    "p4_excess": ("pages BETWEEN 2 AND source_pages AND outside_pages >= 0 AND ratio >= 0 AND (ratio > 0 OR NOT excess)", None),
    "p5_found": ("field IN ('title', 'description', 'text')", None),
    "p5_rates": ("n_truncated BETWEEN 0 AND n_values AND abs(rate - n_truncated / n_values) < 0.0001", None),
    "p6_found": ("place IN ('docs.title', 'docs.text', 'terms.display')", None),
    "p6_forms": ("form IS NOT NULL OR size(issues) = 0", None),
    "p8_ids": ("forall(ids, i -> i BETWEEN 0 AND 60000)", "documents"),
    "p9_containers": ("n_tokens >= 0 AND (container_id IS NULL) = (n_tokens = 0)", None),
    "p9_fill": ("containers >= least_containers AND containers <= 1.02 * least_containers + 1 AND unused_share BETWEEN 0 AND 1", "size_profiles"),
    "p10_pieces": ("n_tokens > 0 AND shared <= start_token AND length(boundary) = 1 AND text IS NOT NULL AND (piece_no > 0 OR start_token = 0)", None),
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.SQL:
        same(df, duck.sql(queries.SQL[name]))
        return
    holds, as_many_as = HOLDS[name]
    df = df.cache()
    assert df.count() > 0 and df.where(f"NOT coalesce({holds}, false)").limit(3).collect() == []
    if as_many_as:
        assert df.count() == spark.read.parquet(f"{sf_dir}/{as_many_as}.parquet").count()
