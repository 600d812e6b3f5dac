"""Every query of the engine against its SQL twin, over whole tables."""

import pytest
from oracle import assert_same, shuffled

from codequarry.plans.change_queries import QUERIES, SQL


#: Queries over line maps, which SQL can't make; test_scan.py holds their operators against plain versions.
WITHOUT_SQL = {"line_map", "clone_subjects", "extension_grading", "deleted_runs", "damage_gaps", "new_suppressions"}


def test_every_other_query_has_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_damage_gaps_by_the_line_map(spark, sf_dir):
    """A span of one line stays unless that line maps from a span of the base."""
    from codequarry.plans import registry

    lines_of = lambda side: {(r.path, r.line) for r in registry._findings(registry.A.snapshot(spark, sf_dir, side)).collect()}
    to = {r.from_path: r.path for r in registry._renames(spark, sf_dir).collect()}
    base = {(to.get(p, p), n) for p, n in lines_of("base")}
    mapped = registry._mapped(spark, sf_dir).collect()
    kept = {(r.path, r.line) for r in mapped if r.line and (r.path, r.base_line) in base}
    want = {x for x in lines_of("cand") if x[0] in {r.path for r in mapped}} - kept
    assert {(r.path, r.start) for r in QUERIES["damage_gaps"](spark, sf_dir).collect()} == want and want


def test_line_maps_cover_both_sides(spark, sf_dir, duck):
    """Kept and deleted lines are the base's, kept and added ones the candidate's."""
    from codequarry.plans import registry

    n = lambda t: len(t.split("\n")) - t.endswith("\n") if t else 0
    base, cand = ({r.path: n(r.text) for r in x.collect()} for x in registry._sides(spark, sf_dir))
    to = {r.path: r.from_path for r in registry._renames(spark, sf_dir).collect()}
    got = QUERIES["line_map"](spark, sf_dir).collect()
    assert all(r.kept + r.deleted == base[to.get(r.path, r.path)] and r.kept + r.added == cand[r.path] for r in got)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert assert_same(QUERIES[name](spark, sf_dir), duck.execute(SQL[name])) > 0


@pytest.mark.parametrize("name", ["verbosity_scores", "report_totals", "location_links"])
def test_repeats_and_members_shuffle_no_text(spark, sf_dir, name):
    """Totals, links and scores need neither digests of texts nor a window over statements."""
    assert not shuffled(QUERIES[name](spark, sf_dir)) & {"token", "tokens", "text"}
