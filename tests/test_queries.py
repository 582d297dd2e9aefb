"""Queries against their SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from atlasmill.plans import registry

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["facilities_dedupe", "indicators_level3", "norm_keys", "hierarchical_sum_check", "context_carry", "point_zone", "zone_vote", "nearest_point_of_many", "weighted_medians", "priority_index", "coverage_gap", "price_ranks", "gini_of_many", "lever_matrix", "census_rows", "merged_labels", "parsed_counts", "distance_profile", "indicators_by_operator", "facility_reference", "level3_index", "extremes", "convergence", "preset_weights", "plausibility_checks", "format_comparison"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    return a == b or (isinstance(a, float | int) and isinstance(b, float | int) and abs(a - b) <= 1e-6 * max(1, abs(a)))


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", ["priority_sensitivity", "priority_mean_spearman", "priority_robust", "gap_sensitivity", "gap_mean_spearman", "gap_variants"])
def test_all_draws_match_sql(spark, con, name):
    test_query_matches_sql(spark, con, name)
    if name.endswith("spearman"):
        assert registry.queries()[name](spark, SF).first().draws == 2000


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_entry_works_without_the_corpus_operators(tmp_path, pipeline_too):
    """On a copy of the repository without the folders, with and without corpus_pipeline.py."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *["corpus_pipeline.py"] * pipeline_too))
    asked = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-B", "-c", asked], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True).stdout.splitlines()
    assert said[-2].split() == sorted(registry.queries()) and said[-1].split() == sorted(registry.oracle_sql())
