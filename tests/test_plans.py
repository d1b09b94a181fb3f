"""Physical plans: what must not appear in them, and what must."""

import contextlib
import io

import pytest

from __spark_entry__ import entry, oracle_sql
from __spark_entry__ import queries as all_queries
from cueflow.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def queries():
    """This library's own; the optional subpackage tests its plans itself."""
    return QUERIES


PYTHON_ALLOWED = {
    "c05", "c06", "a05", "p06", "d15",
}
WRITES = {"s01", "x01", "x02", "x03", "d12"}


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", [n for n in sorted(queries()) if n[:3] not in WRITES])
def test_no_cross_joins_and_no_stray_python(spark, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan
    if name[:3] not in PYTHON_ALLOWED:
        assert "Python" not in plan and "Pandas" not in plan


def test_segment_rules_need_no_shuffle(spark):
    from cueflow.operators.rules import segment_issues

    seg = spark.range(10).selectExpr(
        "cast(id as string) doc_id", "id pos", "id idx", "id start_ms", "id + 5 end_ms", "'x' text")
    assert "Exchange" not in plan_of(segment_issues(seg))


def test_parsing_needs_no_shuffle(spark):
    from cueflow.sources.codec import parse

    docs = spark.range(10).selectExpr("cast(id as string) doc_id", "'srt' format", "'x' content")
    assert "Exchange" not in plan_of(parse(docs))


def test_scans_read_only_what_is_used(spark):
    plan = plan_of(queries()["d02_outcome_stats"](spark, FOLDER))
    assert "l_extendedprice" not in plan and "l_suppkey" in plan


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(all_queries())


def test_entry_runs(spark):
    assert entry(spark).limit(1).count() == 1


def test_tenant_corrections_are_dealt_out_once(spark):
    """One shuffle by tenant and text, of lines as they are read; they are ranked where they land."""
    plan = plan_of(queries()["d04_tenant_context"](spark, FOLDER))
    assert plan.count("Exchange hashpartitioning(") == 1 and "REPARTITION_BY_NUM" in plan
    assert "Aggregate" not in plan[plan.index("Exchange hashpartitioning("):]
