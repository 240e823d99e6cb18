"""The frontier machine against a plain one, page by page and source by source."""

import collections
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.plans import queries
from tessera.sources import scan

SINCE = date(2024, 1, 10)


def plain(pages, saved, since, shallow=1, budget=3):
    """(outcome, number of pages, boundary, its date, hint, ids) of one source; pages: lists of (id, time), None where reading fails."""
    if len(saved) > 1:
        return ("refused", 0, *saved[0], set())
    boundary, day, hint = saved[0] if saved else (None, None, None)
    if saved and (hint is None or hint < 1 or (boundary is None) != (day is None) or (boundary is None and hint != 1)):
        return ("refused", 0, boundary, day, hint, set())
    get = lambda k: pages[k] if k < len(pages) else []
    had = {k: get(k) for k in range(shallow)}
    ids = {i for x in had.values() if x for i, _ in x}
    if any(x is None for x in had.values()):
        return ("failed" if had[0] is None else "partial", len(had), boundary, day, hint, ids)
    rows = [(k, i, at) for k in had for i, at in had[k]]
    if boundary is None:
        return ("initial", len(had), rows[-1][1] if rows else None, rows[-1][2].date() if rows else None, 1, ids)
    if day < since:
        return ("expired", len(had), boundary, day, hint, ids)
    found = next((k for k, i, _ in rows if i == boundary), None)
    ask = shallow if found is not None else max(hint, shallow)
    ended = False
    while len(had) < budget and not ended:
        had[ask] = get(ask)
        if had[ask] is None:
            return ("partial", len(had), boundary, day, hint, {i for x in had.values() if x for i, _ in x})
        if found is None and any(i == boundary for i, _ in had[ask]):
            found = ask
        ended = not had[ask]
        ask += 1
    rows = [(k, i, at) for k in sorted(had) for i, at in had[k]]
    ids = {i for _, i, _ in rows}
    if found is None:
        last = max(had)
        return ("missing", len(had), boundary, day, last + 1 if had[last] and last >= hint else hint, ids)
    behind = rows[[i for _, i, _ in rows].index(boundary) + 1 :]
    return ("active", len(had), behind[-1][1], behind[-1][2].date(), behind[-1][0] + 1, ids) if behind else ("active", len(had), boundary, day, found + 1, ids)


@pytest.mark.parametrize(("shallow", "budget"), [(1, 3), (2, 4), (1, 1)])
def test_every_state_of_a_frontier(spark, shallow, budget):
    start = datetime(2024, 3, 1)
    pages, saved = {}, collections.defaultdict(list)
    for length in (0, 1, 3, 4, 9, 20):
        for mark in (None, 0, 2, 4, 7, 11, 19, "gone", "old", "bad", "half", "twice", "lone"):
            for hint in (1, 2, 3):
                for fails in (None, 0, 1, 2):
                    if (fails and hint == 3) or (isinstance(mark, int) and mark >= length):
                        continue
                    s = f"{length}-{mark}-{hint}-{fails}"
                    ids = [(f"i{k}", start - timedelta(days=k)) for k in range(length)]
                    pages[s] = [None if k == fails else ids[3 * k : 3 * k + 3] for k in range(-(-length // 3))]
                    if isinstance(mark, int):
                        saved[s] = [(f"i{mark}", (start - timedelta(days=mark)).date(), hint)]
                    elif mark is not None:
                        day = date(2024, 2, 1)
                        saved[s] = {"gone": [("none", day, hint)], "old": [("none", date(2023, 1, 1), hint)], "bad": [("none", day, 0)], "half": [("i1", None, hint)], "twice": [("i1", day, hint)] * 2, "lone": [(None, None, hint)]}[mark]
    rows = [(s, k, n, *x, None) for s, own in pages.items() for k, p in enumerate(own) for n, x in enumerate(p or ())] + [(s, k, 0, None, None, "status 503") for s, own in pages.items() for k, p in enumerate(own) if p is None]
    table = spark.createDataFrame(rows, "source string, page int, place int, native_id string, published_at timestamp, failure string")
    before = spark.createDataFrame([(s, *x) for s, own in saved.items() for x in own], scan.FRONTIER)
    taken, states = scan.scan(scan.stored_reader(table), spark.createDataFrame([(s,) for s in pages], "source string"), before, F.lit(SINCE), shallow, budget)
    got = collections.defaultdict(set)
    for r in taken.collect():
        got[r.source].add(r.native_id)
    found = {r.source: (r.outcome, r.n_pages, r.boundary_id, r.boundary_date, r.hint) for r in states.collect()}
    assert set(found) == set(pages)
    for s, own in pages.items():
        *want, ids = plain(own, saved[s], SINCE, shallow, budget)
        assert found[s] == tuple(want), s
        assert got[s] == ids, s
    assert {x[0] for x in found.values()} >= {"initial", "active", "missing", "expired", "failed", "refused"}


def test_the_registered_scan(spark):
    sf = "/root/testdata/sf0.001"
    pages, saved = queries.paged(spark, sf)
    lists = collections.defaultdict(dict)
    for r in sorted(pages.collect(), key=lambda r: (r.page, r.place)):
        lists[r.source].setdefault(r.page, []).append((r.native_id, r.published_at))
    known = collections.defaultdict(list)
    for r in saved.collect():
        known[r.source].append((r.boundary_id, r.boundary_date, r.hint))
    found = {r.source: (r.outcome, r.n_pages, r.boundary_id, r.boundary_date, r.hint) for r in queries.adaptive_scan(spark, sf).collect()}
    assert set(found) == set(lists)
    for s, own in lists.items():
        outcome, n, boundary, day, hint, _ = plain([own[k] for k in sorted(own)], known[s], date(2024, 1, 10))
        assert found[s] == (outcome, n, boundary, day and day.isoformat(), hint), s
    assert len({x[0] for x in found.values()}) >= 4
