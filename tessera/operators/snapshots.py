"""State tables in versions: a staged write, an atomic pointer, readers by version, refused rows, dry runs.

A table is a folder. ``write`` puts the rows of the next version in a data folder
of its own and then renames a manifest, written aside, to the version's number.
The rename is what commits: before it readers see the old version, and of two
writers that began from the same version the second one fails. A writer that is
killed leaves a folder that no manifest names, which ``expire`` removes.

A row that breaks a rule of the table is not written but kept beside the version,
with the rule. A table that was never written is empty; one whose manifest or
schema can't be used is an error, never an empty table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class StateError(RuntimeError):
    """A state table that can't be trusted, or was written by another since it was read."""


@dataclass(frozen=True)
class Kind:
    """What a state table holds.

    ``rules``: by name, what a row must not be; a rule is built when it is used, as columns need a session. ``migrations``: for
    each older schema version what makes its rows rows of the next. ``hours`` of ``at`` and ``most`` rows by ``order`` are kept (memories);
    with ``hard`` more than ``most`` rows are an error (queues).
    """

    schema: str
    key: tuple[str, ...]
    version: int = 1
    rules: dict[str, Callable[[], Column]] = field(default_factory=dict)
    migrations: dict[int, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    at: str | None = None
    hours: int | None = None
    most: int | None = None
    order: str | None = None
    hard: bool = False

    def retained(self, rows: DataFrame, now: Column) -> DataFrame:
        if self.hours is not None:
            rows = rows.where(F.unix_timestamp(self.at) >= F.unix_timestamp(now) - self.hours * 3600)
        if self.most is not None and not self.hard:
            rows = rows.orderBy(F.desc(self.order), *map(F.desc, self.key)).limit(self.most)
        return rows


class Table:
    def __init__(self, spark: SparkSession, path: str, kind: Kind) -> None:
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind
        self.schema = StructType.fromDDL(kind.schema)
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # ------------------------------------------------------------ manifests

    def _children(self, name: str) -> list[str]:
        at = self._paths(f"{self.path}/{name}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._children("versions") if n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """Of a version, the newest by default; None if nothing was ever written."""
        known = self.versions()
        if not known and version is None:
            return None
        version = known[-1] if version is None else version
        if version not in known:
            raise StateError(f"{self.path}: no version {version}")
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).collect())
        try:
            found = json.loads(text)
        except ValueError as e:
            raise StateError(f"{self.path}: the manifest of version {version} can't be read") from e
        if not isinstance(found, dict) or found.get("version") != version or not {"data", "schema", "schema_version", "rows", "refused"} <= set(found):
            raise StateError(f"{self.path}: the manifest of version {version} has not its shape")
        return found

    def _commit(self, manifest: dict) -> None:
        jvm = self.spark._jvm
        target, aside = (self._paths(f"{self.path}/versions/{n}") for n in (f"{manifest['version']}.json", f"_{uuid.uuid4().hex}"))
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(aside), context.makeQualified(target), none)  # fails where the target exists
        except Exception as e:
            self._fs.delete(aside, False)
            raise StateError(f"{self.path}: version {manifest['version']} was written by another") from e

    # ------------------------------------------------------------ reading

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if found is None:
            return self.spark.createDataFrame([], self.schema)
        if found["schema_version"] > self.kind.version:
            raise StateError(f"{self.path}: schema version {found['schema_version']} is newer than {self.kind.version}")
        rows = self.spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{self.path}/{found['data']}/_refused=false") if found["rows"] else self.spark.createDataFrame([], StructType.fromJson(found["schema"]))
        for v in range(found["schema_version"], self.kind.version):
            if v not in self.kind.migrations:
                raise StateError(f"{self.path}: nothing leads from schema version {v} to {v + 1}")
            rows = self.kind.migrations[v](rows)
        return self._shaped(rows)

    def _shaped(self, rows: DataFrame) -> DataFrame:
        have = {f.name: f.dataType.simpleString() for f in rows.schema}
        want = {f.name: f.dataType.simpleString() for f in self.schema}
        if have != want:
            raise StateError(f"{self.path}: columns {sorted(set(have.items()) ^ set(want.items()))} are not as declared")
        return rows.select(*want)

    def refused(self, version: int | None = None) -> DataFrame:
        """Rows that a version was not given, with ``problem``."""
        found = self.manifest(version)
        schema = StructType.fromDDL(self.kind.schema).add("problem", "string") if found is None else StructType.fromJson(found["schema"]).add("problem", "string")
        if found is None or not found["refused"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{found['data']}/_refused=true")

    # ------------------------------------------------------------ writing

    def _judged(self, rows: DataFrame) -> DataFrame:
        """Rows with ``problem``: the first rule that they break. Keys that occur twice are one too: which row is right isn't known."""
        rules = {f"{k} is missing": F.col(k).isNull() for k in self.kind.key} | {name: F.coalesce(rule(), F.lit(False)) for name, rule in self.kind.rules.items()}
        twice = rows.groupBy(*self.kind.key).agg(F.count("*").alias("_n")).where("_n > 1").select(*self.kind.key, F.lit(True).alias("_twice"))
        problem = F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules.items()], F.when(F.col("_twice"), "its key is not unique"))
        return rows.join(twice, list(self.kind.key), "left").select(*rows.columns, problem.alias("problem"))

    def write(self, rows: DataFrame, now: Column | None = None, strict: bool = False, note: str | None = None, dry_run: bool = False) -> dict:
        """The next version. ``now``: with the kind's retention as of then; ``strict``: refused rows are an error. ``dry_run``: what would be written, and nothing is."""
        last = self.versions()
        rows = self._shaped(rows)
        data = f"data/{uuid.uuid4().hex}"
        judged = self._judged(rows)
        good = judged.where("problem IS NULL")
        good = good if now is None else self.kind.retained(good, now)
        bad = judged.where("problem IS NOT NULL")
        good.unionByName(bad).withColumn("_refused", F.col("problem").isNotNull()).write.partitionBy("_refused").parquet(f"{self.path}/{data}")
        try:
            written = self.spark.read.schema(StructType(list(self.schema)).add("problem", "string").add("_refused", "boolean")).parquet(f"{self.path}/{data}")
            n = {r._refused: r.n for r in written.groupBy("_refused").agg(F.count("*").alias("n")).collect()}
            manifest = {"version": (last[-1] if last else 0) + 1, "data": data, "schema": json.loads(self.schema.json()), "schema_version": self.kind.version, "rows": n.get(False, 0), "refused": n.get(True, 0), "note": note}
            if strict and manifest["refused"]:
                raise StateError(f"{self.path}: {manifest['refused']} rows break the table's rules")
            if self.kind.hard and self.kind.most is not None and manifest["rows"] > self.kind.most:
                raise StateError(f"{self.path}: a queue of {manifest['rows']} rows; at most {self.kind.most} may wait")
            if not dry_run:
                self._commit(manifest)
        except BaseException:
            self._fs.delete(self._paths(f"{self.path}/{data}"), True)
            raise
        if dry_run:
            self._fs.delete(self._paths(f"{self.path}/{data}"), True)
        return manifest

    def changes(self, rows: DataFrame | None = None, before: int | None = None, after: int | None = None) -> DataFrame:
        """The key and ``change`` (new, changed, gone) from a version to another, or to ``rows`` that are not written."""
        old = self.read(before)
        new = self.read(after) if rows is None else self._shaped(rows)
        content = [f.name for f in self.schema if f.name not in self.kind.key]
        o, n = (d.select(*self.kind.key, F.struct(F.lit(1), *content).alias(name)) for d, name in ((old, "_old"), (new, "_new")))
        both = o.join(n, list(self.kind.key), "full_outer")
        change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
        return both.select(*self.kind.key, change.alias("change")).where("change IS NOT NULL")

    def expire(self, keep: int = 2) -> None:
        """Remove all versions but the newest, and data that no version names. Nobody may be writing."""
        if keep < 1:
            raise ValueError("the newest version stays")
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._paths(f"{self.path}/versions/{v}.json"), False)
        named = {self.manifest(v)["data"] for v in known[-keep:]}
        for name in self._children("data"):
            if f"data/{name}" not in named:
                self._fs.delete(self._paths(f"{self.path}/data/{name}"), True)
        for name in self._children("versions"):
            if name.startswith("_"):
                self._fs.delete(self._paths(f"{self.path}/versions/{name}"), False)


# ---------------------------------------------------------------- the tables of a run


def _blank(c: str) -> Callable[[], Column]:
    return lambda: F.trim(F.col(c)) == ""


def _with_defaults(rows: DataFrame) -> DataFrame:
    """Event state before revisions were kept."""
    return rows.withColumns({"revision": F.lit(1), "history": F.array().cast("array<string>"), "superseded_by": F.lit(None).cast("string")})


#: Fixed values of the interface: hours, bounds and shapes of each table.
KINDS: dict[str, Kind] = {
    "seen": Kind("fingerprint string, place bigint", ("fingerprint",), rules={"a blank fingerprint": _blank("fingerprint")}, most=25_000, order="place"),
    "candidates": Kind(
        "candidate_id string, source_id string, content_hash string, first_seen timestamp, last_seen timestamp", ("candidate_id",), at="last_seen", hours=90 * 24, most=10_000, order="last_seen",
        rules={"no source": lambda: F.col("source_id").isNull(), "seen last before first": lambda: F.col("last_seen") < F.col("first_seen")},
    ),
    "observations": Kind(
        "source_id string, observation_id string, digest string, last_seen timestamp", ("source_id", "observation_id"), at="last_seen", hours=90 * 24,
        rules={"no digest": lambda: F.col("digest").isNull()},
    ),
    "cards": Kind(
        "candidate_id string, source_id string, published_at timestamp, last_seen timestamp, entities array<string>, tokens array<string>, content_hash string, quality string, score int, amounts array<double>",
        ("candidate_id",), at="published_at", hours=72, most=500, order="last_seen",
        rules={
            "no source or times": lambda: F.col("source_id").isNull() | F.col("published_at").isNull() | F.col("last_seen").isNull(),
            "an unknown quality": lambda: ~F.col("quality").isin("primary", "high_signal", "discovery"),
            "a score beyond 0 to 100": lambda: ~F.col("score").between(0, 100),
            "quality without score": lambda: F.col("quality").isNull() != F.col("score").isNull(),
            "amounts that aren't positive": lambda: F.exists("amounts", lambda x: ~F.coalesce((x > 0) & (x < float("inf")), F.lit(False))),
        },
    ),
    "outbox": Kind(
        "key string, title string, url string, score int, reasons array<string>, content_hash string, queued_at timestamp", ("key",), most=250, order="queued_at", hard=True,
        rules={"no title": _blank("title"), "no https address": lambda: ~F.col("url").startswith("https://"), "no time": lambda: F.col("queued_at").isNull()},
    ),
    "event_outbox": Kind(
        "event_id string, event_type string, summary string, payload string, queued_at timestamp", ("event_id",), most=250, order="queued_at", hard=True,
        rules={"no summary": _blank("summary"), "no time": lambda: F.col("queued_at").isNull()},
    ),
    "deliveries": Kind("key string, delivered_at timestamp", ("key",), at="delivered_at", hours=35 * 24, most=2_000, order="delivered_at", rules={"no time": lambda: F.col("delivered_at").isNull()}),
    "ledger_ids": Kind("event_id string, delivered_at timestamp", ("event_id",), version=2, at="delivered_at", hours=35 * 24, most=2_000, order="delivered_at", rules={"no time": lambda: F.col("delivered_at").isNull()}, migrations={1: lambda rows: rows}),
    "ledger_signatures": Kind("signature string, delivered_at timestamp", ("signature",), at="delivered_at", hours=72, most=2_000, order="delivered_at", rules={"no time": lambda: F.col("delivered_at").isNull()}),
    "quarantine": Kind("event_id string, reason string, quarantined_at timestamp", ("event_id",), most=1_000, order="quarantined_at", hard=True, rules={"no reason": _blank("reason")}),
    "events": Kind(
        "event_id string, status string, payload_hash string, updated_at timestamp, revision int, history array<string>, superseded_by string", ("event_id",), version=2, most=500, order="updated_at",
        rules={"more history than revisions": lambda: F.size("history") > F.col("revision"), "more than ten old revisions": lambda: F.size("history") > 10, "replaced by itself": lambda: F.col("superseded_by") == F.col("event_id")},
        migrations={1: _with_defaults},
    ),
}


def table(spark: SparkSession, root: str, name: str) -> Table:
    """A table of the run's state under ``root``."""
    return Table(spark, f"{root.rstrip('/')}/{name}", KINDS[name])
