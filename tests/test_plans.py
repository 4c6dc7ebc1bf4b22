"""Physical plans: what is read, shuffled and broadcast."""

import re

import pytest

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", text)


def test_flagship_reads_four_columns_and_never_shuffles_the_expansion(spark):
    text = plan(spark, "flagship")
    scan = re.search(r"FileScan parquet \[([^\]]*)\]", text).group(1)
    assert "props" not in scan
    assert shuffles(text) == ["hashpartitioning"] * 2
    assert text.index("Generate explode") < text.index("Exchange hashpartitioning")
    assert re.search(r"WindowGroupLimit .* Partial", text)


@pytest.mark.parametrize(
    "name",
    "lookback_expand hash_split enrich_weather attach_sequence recorded_only threshold_label "
    "softmax layer_norm clamp convolve_sequence standardize one_hot_columns drop_excess".split(),
)
def test_row_wise_operators_do_not_shuffle_their_rows(spark, name):
    text = plan(spark, name)
    main = text.split("BroadcastExchange")[0]
    assert shuffles(main) == []
    assert "Python" not in text and "BatchEval" not in text


@pytest.mark.parametrize(
    "name",
    "build_combined merge_insert_only merge_into_unique backfill_weather boxplot_stats "
    "boxplot_stats_per_site pool_windows moving_kernel exact_split assign_batches "
    "scatter_bins label_encode correlation_matrix missing_weather_dates".split(),
)
def test_no_pairwise_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_preview_keeps_n_rows_per_task(spark):
    assert "TakeOrderedAndProject" in plan(spark, "preview")


def test_filters_reach_the_scan(spark):
    text = plan(spark, "check_label_range")
    assert "PushedFilters: [" in text and "label" in text.split("ReadSchema")[1]
    assert "embedding" not in text.split("ReadSchema")[1]
