"""Properties of physical plans that matter at scale."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.oracles import ORACLES
from workload.spark_queries import QUERIES

SF = "/root/testdata/sf0.001"
PYTHON = ("generate_hook", "generate_resumed", "scorer_hook", "embed_hook", "error_isolation", "benchmark_run",
          "generation_accounting")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["leaderboard_flagship", "token_f1_pairs", "token_f1_documents", "summary_minimal",
     "split_exact", "split_caps", "dense_index", "positional_index", "early_stop", "exact_median",
     "best_checkpoint", "keep_last", "run_telemetry", "layered_merge", "parse_scalar"],
)
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(queries()[name](spark, SF))
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scoring_a_pair_needs_no_shuffle(spark):
    from pyspark.sql import functions as F

    from evalweave.operators.scoring import score_answers

    df = spark.range(10).select(
        F.lit("x").alias("raw_generation"), F.col("id").cast("string").alias("reference_answer")
    )
    assert "Exchange" not in plan_of(score_answers(df))


def test_split_shuffles_only_ids(spark):
    """The payload is filtered by constants: its side of the plan has no exchange."""
    from evalweave.operators.sampling import split_exact

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = plan_of(split_exact(docs, 0.5, row_id="doc_id"))
    main = [line for line in plan.splitlines() if re.match(r"^ *\+- (\*\(\d+\) )?\w", line)]
    assert not any("Exchange" in line for line in main)
    for exchange in re.findall(r"Exchange .*", plan):
        assert "text" not in exchange


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_positions_move_the_rows_once(spark, no_broadcast):
    """Window and join share one partitioning: no second exchange of the rows."""
    from evalweave.operators.sampling import dense_index

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = plan_of(dense_index(docs, "doc_id", seed=1, by=["lang"]))
    below_join = plan[plan.index("SortMergeJoin") :].splitlines()
    rows_side = [line for line in below_join if line.lstrip().startswith(":")]
    assert sum("Exchange" in line for line in rows_side) == 1
    assert any("text" in line for line in rows_side)


def test_top_k_per_group_is_cut_before_the_shuffle(spark):
    for name in ("disagreement_report", "top_candidates"):
        assert plan_of(queries()[name](spark, SF)).count("WindowGroupLimit") == 2


def test_column_pruning_reaches_the_scan(spark):
    plan = plan_of(queries()["dense_index"](spark, SF))
    for schema in re.findall(r"ReadSchema: (\S+)", plan):
        assert "text" not in schema


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_a_merge_of_configurations_joins_on_runs_and_keys(spark, no_broadcast):
    """Joins that adaptive execution can split, and no array of a run's entries."""
    plan = plan_of(queries()["layered_merge"](spark, SF))
    assert "collect_list" not in plan and "CartesianProduct" not in plan
    assert plan.count("SortMergeJoin") == 2 and "LeftAnti" in plan and "LeftSemi" in plan
    assert plan.count("named_struct(run_id") + plan.count("struct(run_id") >= 2


def test_reference_scores_count_nothing_while_they_are_built(spark):
    """The only jobs read the schemas of the three tables."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    queries()["reference_scores"](spark, SF)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("building")) <= 3


def test_entry(spark):
    assert entry(spark).count() == 4
