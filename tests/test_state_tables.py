"""Versioned state tables and state with a trailing time."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import snapshots
from tessera.operators.snapshots import Kind, StateError, Table
from tessera.streaming import jobs, trailing

KIND = Kind("k int, v string", ("k",), rules={"a blank value": lambda: F.trim("v") == ""})


def rows(spark, *given):
    return spark.createDataFrame(list(given), "k int, v string")


def content(df):
    return {r.k: r.v for r in df.collect()}


def test_versions_refused_rows_and_changes(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", KIND)
    assert table.read().count() == 0 and table.versions() == [] and table.manifest() is None and table.refused().count() == 0
    first = table.write(rows(spark, (1, "a"), (2, "b"), (3, " "), (None, "x"), (4, "p"), (4, "q")))
    assert (first["version"], first["rows"], first["refused"]) == (1, 2, 4)
    assert {(r.k, r.problem) for r in table.refused().collect()} == {(3, "a blank value"), (None, "k is missing"), (4, "its key is not unique")}
    table.write(rows(spark, (2, "c"), (5, "n")))
    assert content(table.read()) == {2: "c", 5: "n"} and content(table.read(1)) == {1: "a", 2: "b"} and table.refused().count() == 0
    assert {(r.k, r.change) for r in table.changes(before=1).collect()} == {(1, "gone"), (2, "changed"), (5, "new")}
    table.write(table.read().limit(0))
    assert table.read().count() == 0 and table.versions() == [1, 2, 3]
    table.expire(2)
    assert table.versions() == [2, 3] and len(list((tmp_path / "t" / "data").iterdir())) == 2
    with pytest.raises(StateError, match="no version 1"):
        table.read(1)


def test_a_dry_run_and_failures_leave_the_table_as_it_was(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", KIND)
    table.write(rows(spark, (1, "a")))
    data = lambda: sorted(p.name for p in (tmp_path / "t" / "data").iterdir())
    before = data()
    new = rows(spark, (1, "b"), (2, ""))
    assert table.write(new, dry_run=True)["refused"] == 1 and {(r.k, r.change) for r in table.changes(new).collect()} == {(1, "changed"), (2, "new")}
    with pytest.raises(StateError, match="break the table's rules"):
        table.write(new, strict=True)
    with pytest.raises(Exception, match="half way"):
        table.write(rows(spark, (7, "z")).withColumn("v", F.raise_error(F.lit("half way")).cast("string")))
    with pytest.raises(StateError, match="not as declared"):
        table.write(rows(spark, (1, "b")).withColumn("w", F.lit(1)))
    assert content(table.read()) == {1: "a"} and table.versions() == [1] and set(before) <= set(data())
    # a writer that was killed before its manifest was renamed leaves data that no version names
    (tmp_path / "t" / "data" / "orphan").mkdir()
    (tmp_path / "t" / "versions" / "_half").write_text("{")
    assert content(table.read()) == {1: "a"}
    table.expire(1)
    assert data() == before and not (tmp_path / "t" / "versions" / "_half").exists()


def test_two_writers_from_one_version(spark, tmp_path, monkeypatch):
    table = Table(spark, f"{tmp_path}/t", KIND)
    table.write(rows(spark, (1, "a")))
    late = Table(spark, f"{tmp_path}/t", KIND)
    monkeypatch.setattr(late, "versions", lambda: [1])
    table.write(rows(spark, (1, "first")))
    with pytest.raises(StateError, match="by another"):
        late.write(rows(spark, (1, "second")))
    assert content(table.read()) == {1: "first"} and len(list((tmp_path / "t" / "data").iterdir())) == 2


def test_schemas_migrations_and_broken_manifests(spark, tmp_path):
    Table(spark, f"{tmp_path}/t", KIND).write(rows(spark, (1, "a")))
    second = Kind("k int, v string, n int", ("k",), version=2, migrations={1: lambda d: d.withColumn("n", F.lit(7))})
    table = Table(spark, f"{tmp_path}/t", second)
    assert [tuple(r) for r in table.read().collect()] == [(1, "a", 7)]
    table.write(table.read().withColumn("n", F.lit(8)))
    assert [r.n for r in table.read().collect()] == [8] and [r.n for r in table.read(1).collect()] == [7]
    with pytest.raises(StateError, match="newer"):
        Table(spark, f"{tmp_path}/t", KIND).read()
    with pytest.raises(StateError, match="nothing leads"):
        Table(spark, f"{tmp_path}/t", Kind("k int, v string", ("k",), version=3)).read()
    for text in ("{", "[]", json.dumps({"version": 2})):
        (tmp_path / "t" / "versions" / "3.json").write_text(text)
        with pytest.raises(StateError):
            table.read()


def test_the_tables_of_a_run(spark, tmp_path):
    now, at = F.lit("2024-06-10").cast("timestamp"), lambda d: datetime(2024, 6, 10) - timedelta(hours=d)
    made = {name: snapshots.table(spark, str(tmp_path), name) for name in snapshots.KINDS}
    assert len(made) >= 9 and all(t.read().count() == 0 for t in made.values())

    def write(name, *given, **options):
        made[name].write(spark.createDataFrame(list(given), snapshots.KINDS[name].schema), **options)
        return made[name].read().collect(), [r.problem for r in made[name].refused().collect()]

    card = lambda k, hours, **x: tuple(({"id": k, "source": "s", "published": at(hours), "seen": at(hours), "entities": ["e"], "tokens": ["t"], "hash": "h", "quality": "primary", "score": 50, "amounts": [1.0]} | x).values())
    kept, refused = write("cards", card("a", 1), card("b", 80), card("c", 1, score=101), card("d", 1, score=None), card("e", 1, amounts=[-1.0]), card("f", 1, quality=None, score=None), card("g", 1, quality="odd"), now=now)
    assert {r.candidate_id for r in kept} == {"a", "f"} and sorted(refused) == ["a score beyond 0 to 100", "amounts that aren't positive", "an unknown quality", "quality without score"]
    kept, _ = write("ledger_signatures", ("new", at(71)), ("old", at(73)), now=now)
    assert [r.signature for r in kept] == ["new"]
    kept, _ = write("ledger_ids", ("new", at(34 * 24)), ("old", at(36 * 24)), now=now)
    assert [r.event_id for r in kept] == ["new"]
    kept, refused = write("events", ("e", "reported", "h", at(1), 2, ["g"], None), ("self", "reported", "h", at(1), 1, [], "self"))
    assert [r.event_id for r in kept] == ["e"] and refused == ["replaced by itself"]
    with pytest.raises(StateError, match="at most 250"):
        made["outbox"].write(spark.range(251).select(F.col("id").cast("string").alias("key"), F.lit("t").alias("title"), F.lit("https://a.example/").alias("url"), F.lit(1).alias("score"), F.array(F.lit("r")).alias("reasons"), F.lit("h").alias("content_hash"), F.current_timestamp().alias("queued_at")))
    assert made["outbox"].read().count() == 0
    old = Table(spark, f"{tmp_path}/before", Kind("event_id string, status string, payload_hash string, updated_at timestamp", ("event_id",)))
    old.write(spark.createDataFrame([("e", "reported", "h", at(1))], old.kind.schema))
    moved = Table(spark, f"{tmp_path}/before", snapshots.KINDS["events"]).read().first()
    assert (moved.revision, moved.history, moved.superseded_by) == (1, [], None)


def test_the_last_of_each_key_over_runs_with_rows_without_and_with(spark, tmp_path):
    def run():
        stream = jobs.read(spark, f"{tmp_path}/in", "k int, at int, v string", files_per_batch=1)
        return {r.k: r.v for r in jobs.latest_by_key(stream, "k", "at", "v", f"{tmp_path}/out", f"{tmp_path}/offsets").collect()}

    add = lambda *given: spark.createDataFrame(list(given), "k int, at int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add((1, 5, "a"), (2, 1, "b"))
    assert run() == {1: "a", 2: "b"}
    assert run() == {1: "a", 2: "b"}
    add((1, 3, "late"), (2, 4, "c"))
    add((3, 1, "d"))
    assert run() == {1: "a", 2: "c", 3: "d"} == run()
    assert len(list((tmp_path / "out" / "data").iterdir())) == 2


def test_trailing_state_tells_new_from_seen_and_goes(spark, tmp_path):
    start = datetime(2024, 1, 1)

    def run(*given):
        made = spark.createDataFrame([(k, n, start + timedelta(hours=h), d) for k, n, h, d in given], "k string, n bigint, at timestamp, d string")
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.read(spark, f"{tmp_path}/in", "k string, n bigint, at timestamp, d string")
        out = jobs.appended(trailing.changes(stream, "k", "n", "at", "d", 72, "1 hour"), f"{tmp_path}/out", f"{tmp_path}/offsets")
        kept = spark.read.format("statestore").option("path", f"{tmp_path}/offsets").option("stateVarName", "last").load().select("key.*").collect()
        return {r.id: (r.change, r.before) for r in out.collect()}, {r[0] for r in kept}

    found, kept = run(("a", 1, 0, "x"), ("a", 2, 10, "x"), ("a", 3, 20, "y"), ("b", 4, 0, "x"), ("a", 5, 20 + 72, "y"))
    assert found == {1: ("new", None), 2: ("same", "x"), 3: ("changed", "x"), 4: ("new", None), 5: ("same", "y")}
    assert kept == {"a"}  # b's time has passed with the watermark
    found, kept = run(("b", 6, 100, "x"), ("c", 7, 400, None), ("c", 8, 401, None))
    assert found[6] == ("new", None) and found[7] == ("new", None) and found[8] == ("same", None) and kept == {"c"}
