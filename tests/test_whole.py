"""Queries that must read every row of their tables, against brute force."""

from collections import defaultdict

import pyarrow.parquet as pq
import pytest

import __spark_entry__
from quarry.plans.facts import KINDS


def read(sf, name, *columns):
    table = pq.read_table(f"{sf}/{name}.parquet", columns=list(columns))
    return list(zip(*[table[c].to_pylist() for c in columns], strict=True))


def run(spark, sf, name):
    return [tuple(r) for r in __spark_entry__.queries()[name](spark, sf).collect()]


@pytest.fixture(scope="module")
def functions(sf):
    """The objects of every kind by user and day, of all events."""
    found = defaultdict(lambda: defaultdict(set))
    for ts, user, kind, value in read(sf, "events", "ts", "user_id", "event_type", "value"):
        found[f"u:{user}@{ts:%Y-%m-%d}"][KINDS.get(kind)].add(f"v{int(value // 10)}")
    return found


def recipe(f):
    reads, writes, guarded, calls, raises = (f[k] for k in ("reads_field", "writes_field", "guarded_write", "calls", "raises"))
    if calls:
        return "Compensate" if raises else "Cascade"
    if raises:
        return "WriteRaise" if writes else "Guard"
    if writes:
        return "Default" if writes == guarded else "Compute" if writes - reads else "Normalize"
    return "Observe" if reads else "Empty"


def test_functions_hold_all_events(spark, sf, functions):
    kinds = ("reads_field", "writes_field", "guarded_write", "calls", "raises")
    want = sorted((s, *(",".join(sorted(f[k])) for k in kinds)) for s, f in functions.items())
    assert sorted(run(spark, sf, "group_functions")) == want


def test_recipes_of_all_events(spark, sf, functions):
    named = defaultdict(list)
    for s, f in sorted(functions.items()):
        named[recipe(f)].append(s)
    assert len(named) > 4
    assert dict(run(spark, sf, "recipe_histogram")) == {k: len(v) for k, v in named.items()}
    assert sorted(run(spark, sf, "recipe_census")) == sorted((k, len(v), ",".join(v[:3])) for k, v in named.items())
    n, good = len(functions), sum(len(named[k]) for k in ("Default", "Compute", "Normalize", "Guard"))
    assert run(spark, sf, "recipe_band")[0][:2] == (n, good)


def test_edges_of_all_lines(spark, sf):
    edges = set(read(sf, "lineitem", "l_suppkey", "l_partkey"))
    listed = lambda nodes, pairs: sorted((n, ",".join(map(str, sorted(b for a, b in pairs if a == n)))) for n in nodes)
    suppliers, parts = {s for (s,) in read(sf, "supplier", "s_suppkey")}, {p for (p,) in read(sf, "part", "p_partkey")}
    assert sorted(run(spark, sf, "import_dependencies")) == listed(suppliers, edges)
    assert sorted(run(spark, sf, "import_dependents")) == listed(parts, {(p, s) for s, p in edges})
    nations = dict(read(sf, "supplier", "s_suppkey", "s_nationkey"))
    want = sorted((f"p{p}", f"s{s}", f"b{s % 7},n{nations[s]}") for s, p in edges if s in nations)
    assert sorted(run(spark, sf, "field_provenance")) == want
