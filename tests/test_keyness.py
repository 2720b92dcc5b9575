"""Keyness with frequent and rare terms, repeated and missing ids, and what of it is shuffled."""

from collections import Counter
from unittest import mock

import pytest

from corpusloom.operators import keyness

ROWS = [(1, "a a b c"), (2, "a b b d"), (1, "A e"), (None, "a z z"), (3, None), (4, ""), (5, "z z z y")]


@pytest.mark.parametrize("frequent", [0, 2, 4, 100])
@pytest.mark.parametrize("least", [1, 2])
def test_against_counting(spark, frequent, least):
    focus = Counter((i, w) for i, t in ROWS for w in (t or "").lower().split())
    total, size = Counter(), Counter()
    for (i, w), n in focus.items():
        total[w] += n
        size[i] += n
    n_all = sum(total.values())
    want = {(i, w, n, total[w] - n, size[i], n_all - size[i]) for (i, w), n in focus.items() if i is not None and n >= least}
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    with mock.patch.object(keyness, "FREQUENT", frequent):
        got = [tuple(r) for r in keyness.leave_one_out(docs, least=least).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_count_is_shuffled_where_all_terms_are_frequent(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = keyness.top_keywords(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc_id" in plan


def test_class_terms_are_cut_once(spark, data):
    """No join of single terms: texts are not in the plan that ranks the counts."""
    from corpusloom.plans import catalog

    plan = catalog.QUERIES["agg35_class_tfidf"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "documents.parquet" not in plan
