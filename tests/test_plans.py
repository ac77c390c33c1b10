"""Plans of the end-to-end jobs: pruning, counts on the way, settings a cluster may have."""

import pytest
from pyspark.sql import Observation

from pricetrace.catalog import ORACLES, QUERIES
from pricetrace.catalog.bindings import WORDS, articles, trades
from pricetrace.plans import jobs
from pricetrace.schemas import ARTICLE_COLUMNS
from pricetrace.scratch import new_path, setting
from pricetrace.sinks import datasets
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rank_articles", "trace_articles", "term_discovery", "best_articles_tfidf", "month_documents"])
def test_without_automatic_broadcast(spark, name):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        assert differences(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name]) is None


def test_trace_prunes_months_and_counts_its_rows(spark):
    path = new_path(spark, "by-month")
    datasets.write_by_month(articles(spark, SF).select(*ARTICLE_COLUMNS, "month"), path, "parquet")
    stored = datasets.read_months(spark, path)
    for target in (None, "199801"):
        seen = Observation()
        traced = jobs.trace_articles(trades(spark, SF), stored, WORDS, target, observation=seen)
        plan = traced._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan
        rows = traced.collect()
        assert seen.get == {"articles": len(rows), "with_body": len(rows)}
