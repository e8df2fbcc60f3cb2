import contextlib
import io

import pytest

import __spark_entry__ as entry
from quire.operators import html, markdown, toc
from quire.plans.queries import QUERIES


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize(
    "name, exchanges, joins",
    [("html_nodes", 1, 0), ("css_select", 1, 0), ("toc_best", 1, 0), ("toc_links", 1, 0), ("page_markdown", 1, 0), ("clean_html", 1, 0), ("scan_catalog", 0, 0)],
)
def test_page_work_moves_pages_once(spark, sf, name, exchanges, joins):
    """One exchange by page, and that because the table is a single file."""
    plan = plan_of(QUERIES[name](spark, sf))
    assert plan.count("Exchange hashpartitioning") == exchanges
    assert plan.count("Join ") == joins
    if name not in ("toc_best", "toc_links"):  # these sort and rank their results, not pages
        assert "Window" not in plan and "Sort " not in plan
    assert len(plan) < 100_000
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoopJoin" not in plan and "Cartesian" not in plan


def test_operators_on_pages_need_no_exchange(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for df in (html.html_nodes(pages), markdown.clean_html(pages), markdown.extract_content(pages, "article"), toc.toc_links(pages)):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Window" not in plan and "Sort " not in plan


def test_a_fetch_job_is_planned_with_few_exchanges(spark, sf):
    assert plan_of(QUERIES["fetch_results"](spark, sf)).count("Exchange hashpartitioning") <= 12


@pytest.mark.parametrize("name", ["word_count", "clean_markdown", "output_paths", "nested_parent", "fetch_results"])
def test_no_python_on_executors(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "Python" not in plan and "Pandas" not in plan


def test_only_needed_columns_are_read(spark, sf):
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan_of(QUERIES["css_select"](spark, sf))
    assert "ReadSchema: struct<url:string>" in plan_of(QUERIES["update_selectors"](spark, sf))


def test_entry_points(spark, sf):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["page_id", "title", "content", "word_count", "error"]
