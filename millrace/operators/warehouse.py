"""A warehouse of Parquet tables: constraints before publishing, atomic refresh, incremental loads.

Each load writes its tables below a new version and publishes it by one numbered file in the
manifest, which names the folders that hold each table, with counts, ranges and a fingerprint of
each.  The file must not exist yet: of two loads onto the same version one is refused.  Readers see
a published version or the one before it, never a part of one; a load that fails leaves the manifest
as it was.

An increment adds a folder to those of the version before, and costs what it brings: of the older
folders only those are read whose ranges and Bloom filters (millrace.operators.keyfilter) admit one
of its keys, and constraints are checked for its rows.  compact() makes one folder of many, vacuum()
deletes what no recent version names.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import keyfilter, storage

LOG = "run_id string, table_name string, mode string, rows_before long, rows_after long, rows_inserted long, started_at timestamp, duration_ms double, status string, message string"
#: Seconds for which a file of the manifest that cannot be read is taken for one that is being written.
WRITING = 60.0


class ConstraintError(ValueError):
    """A table breaks a constraint; nothing was published."""


class ConflictError(RuntimeError):
    """Another load has published meanwhile; nothing was published."""


@dataclass(frozen=True)
class Check:
    name: str
    condition: str


@dataclass(frozen=True)
class Constraints:
    """A null in a check's condition passes, as in SQL.  Rows are also found by the columns of `indexed`."""

    key: Sequence[str] = ()
    unique: Sequence[Sequence[str]] = ()
    required: Sequence[str] = ()
    checks: Sequence[Check] = ()
    foreign: Sequence[tuple[str, str, str]] = ()
    indexed: Sequence[Sequence[str]] = ()


STAR = {
    "dim_date": Constraints(key=["date_key"]),
    "dim_branch": Constraints(key=["branch_id"]),
    "dim_product": Constraints(key=["product_id"]),
    "dim_member": Constraints(key=["member_id"]),
    "fact_sales": Constraints(
        key=["sale_line_id"], unique=[["receipt_id", "product_id"]], required=["receipt_id", "date_key", "branch_id", "product_id", "qty", "unit_price", "line_total"],
        checks=[Check("qty", "qty > 0"), Check("unit_price", "unit_price > 0"), Check("size", "size in ('S', 'M', 'L')")],
        foreign=[("date_key", "dim_date", "date_key"), ("branch_id", "dim_branch", "branch_id"), ("product_id", "dim_product", "product_id"), ("member_id", "dim_member", "member_id")],
        indexed=[["receipt_id"]],
    ),
    "reco_rules": Constraints(
        key=["antecedent", "consequent"], required=["antecedent_name", "consequent_name", "count_ab", "count_a", "support", "confidence", "lift"],
        checks=[Check("support", "support between 0 and 1"), Check("confidence", "confidence between 0 and 1"), Check("lift", "lift > 0")],
        foreign=[("antecedent", "dim_product", "product_id"), ("consequent", "dim_product", "product_id")],
    ),
    "forecast_daily": Constraints(key=["branch", "date"]),
    "forecast_coefficients": Constraints(key=["feature"]),
    "forecast_next_week": Constraints(key=["branch", "date"]),
}


def violations(name: str, df: DataFrame, rule: Constraints, tables: dict[str, DataFrame], nulls: bool = True) -> DataFrame:
    """(table, constraint, rows) with the number of rows that break each constraint; nulls of the key if asked for."""
    keys = [*([rule.key] if rule.key else []), *rule.unique]
    plain = [(f"not null {c}", F.col(c).isNull()) for c in ((*rule.required, *rule.key) if nulls else ())] + [(f"check {c.name}", ~F.coalesce(F.expr(c.condition), F.lit(True))) for c in rule.checks]
    row = lambda what, n: F.struct(F.lit(name).alias("table"), F.lit(what).alias("constraint"), n.alias("rows"))
    out = None
    if plain:
        counted = df.agg(*(F.count_if(c).alias(str(i)) for i, (_, c) in enumerate(plain)))
        out = counted.select(F.explode(F.array(*(row(what, F.col(str(i))) for i, (what, _) in enumerate(plain)))).alias("r")).select("r.*")
    for key in keys:
        repeated = df.groupBy(*key).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).select(row(f"unique {', '.join(key)}", F.col("n")).alias("r")).select("r.*")
        out = repeated if out is None else out.unionByName(repeated)
    for column, parent, target in rule.foreign:
        orphans = df.where(F.col(column).isNotNull()).join(tables[parent].select(F.col(target).alias("_t")), F.col(column) == F.col("_t"), "left_anti")
        counted = orphans.agg(F.count(F.lit(1)).alias("n")).select(row(f"foreign key {column}", F.col("n")).alias("r")).select("r.*")
        out = counted if out is None else out.unionByName(counted)
    return out


Folder = dict
#: A replaced table, or rows to add with the keys whose older rows they replace.
Change = DataFrame | tuple[DataFrame, DataFrame | None]


@dataclass(frozen=True)
class Increment:
    """What a load adds: its rows, and published rows found by keys that the filters know."""

    rows: DataFrame
    table: Callable[[str], DataFrame]
    found: Callable[[Sequence[str]], DataFrame | None]


@dataclass(frozen=True)
class Version:
    """number orders the files of the manifest; tables have a schema and folders, oldest first."""

    number: int
    name: str | None
    tables: dict[str, dict]


def _text(value: object) -> object:
    """A value as JSON holds it, in an order that is kept; None where there is none."""
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat(" ") if isinstance(value, datetime.datetime) else value.isoformat()
    return value if isinstance(value, (int, float, str)) else None

def _schema(table: dict) -> StructType:
    return StructType.fromJson(table["schema"])


def _rows(table: dict | None) -> int | None:
    return None if table is None else sum(f["rows"] for f in table["folders"])


def _meet(a: Folder, b: Folder, column: str) -> bool:
    """Can rows of both folders have the same value?  Yes where a range is not known."""
    if a["nulls"].get(column) and b["nulls"].get(column):
        return True
    ranges = [x[k].get(column) for x in (a, b) for k in ("low", "high")]
    if any(column not in x["low"] for x in (a, b)):
        return True
    if any(r is None for r in ranges):  # only nulls on one side
        return False
    return ranges[0] <= ranges[3] and ranges[2] <= ranges[1]


def _among(rows: DataFrame, others: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on columns, nulls being equal."""
    keys = storage.small(others.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(columns))).distinct())
    return rows.join(keys, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(columns))), how)


def fingerprint(columns: Sequence[str]) -> list[Column]:
    """Aggregates that don't depend on the order of rows, but on each row as a whole and how often it is there."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in columns))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"), F.coalesce(F.bit_xor(h), F.lit(0)).cast("string").alias("xor")]


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, constraints: dict[str, Constraints] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.constraints = STAR if constraints is None else constraints

    # -- files that are no tables

    def _path(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at, fs = self._path(path)
        return fs.exists(at)

    def _names(self, path: str) -> dict[str, float]:
        """What lies below a folder, with the time of its last change in seconds."""
        at, fs = self._path(path)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(at)} if fs.exists(at) else {}

    def _create(self, path: str, text: str) -> None:
        """Write a file that must not exist yet."""
        at, fs = self._path(path)
        out = fs.create(at, False)
        out.write(text.encode())
        out.close()

    def _content(self, path: str) -> dict | None:
        at, fs = self._path(path)
        stream = fs.open(at)
        try:
            text = self.spark._jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A")
            return json.loads(text.next()) if text.hasNext() else None
        except ValueError:
            return None
        finally:
            stream.close()

    def _delete(self, path: str) -> None:
        at, fs = self._path(path)
        fs.delete(at, True)

    # -- versions

    def _current(self) -> Version:
        names = self._names("manifest")
        for file in sorted((n for n in names if n.endswith(".json")), reverse=True):
            content = self._content(f"manifest/{file}")
            while content is None and time.time() - names[file] < WRITING:  # it is being written
                time.sleep(0.1)
                content = self._content(f"manifest/{file}")
            if content is not None:
                return Version(int(max(names)[:12]), content["version"], content["tables"])
        return Version(int(max(names)[:12]) if names else 0, None, {})

    def version(self) -> str | None:
        return self._current().name

    def names(self) -> list[str]:
        return sorted(self._current().tables)

    def folders(self, name: str) -> int:
        return len(self._current().tables[name]["folders"])

    def _read(self, name: str, table: dict, only: Sequence[str] | None = None) -> DataFrame:
        """A table's rows; of its folders with the versions `only`, if given."""
        groups: list[tuple[list[str], list[str]]] = []
        later: list[str] = []
        for folder in reversed(table["folders"]):
            if only is None or folder["version"] in only:
                if not groups or groups[-1][1] != later:
                    groups.append(([], list(later)))
                groups[-1][0].append(f"{self.root}/versions/{folder['version']}/{name}")
            if folder["replaces"]:
                later.append(f"{self.root}/versions/{folder['version']}/{name}-replaced")
        out = None
        for paths, replaced in groups or [([], [])]:
            part = self.spark.read.schema(_schema(table)).parquet(*paths) if paths else self.spark.createDataFrame([], _schema(table))
            if replaced:
                part = part.join(storage.small(self.spark.read.parquet(*replaced).distinct()), list(next(f["replaces"] for f in table["folders"] if f["replaces"])), "left_anti")
            out = part if out is None else out.unionByName(part)
        return out.select(*_schema(table).names)

    def table(self, name: str) -> DataFrame:
        return self._read(name, self._current().tables[name])

    def _publish(self, onto: Version, version: str, tables: dict[str, dict]) -> None:
        content = json.dumps({"version": version, "published_at": time.time(), "tables": tables})
        try:
            if self._current().number != onto.number:
                raise ConflictError(f"version {onto.name} is no longer the last one")
            self._create(f"manifest/{onto.number + 1:012d}.json", content)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                raise ConflictError(f"version {onto.name} is no longer the last one") from e
            raise

    def _log(self, rows: list[tuple]) -> None:
        names = [c.split()[0] for c in LOG.split(", ")]
        self._create(f"etl_load_log/{time.time_ns()}-{uuid.uuid4().hex[:6]}.json", "\n".join(json.dumps(dict(zip(names, (_text(v) if isinstance(v, datetime.datetime) else v for v in r)))) for r in rows) + "\n")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).json(f"{self.root}/etl_load_log")

    # -- writing

    def _indexes(self, name: str, more: Sequence[Sequence[str]] = ()) -> list[list[str]]:
        rule = self.constraints.get(name, Constraints())
        found = [list(s) for s in (rule.key, *rule.unique, *rule.indexed, *more) if s]
        return [s for i, s in enumerate(found) if s not in found[:i]]

    def _write(self, name: str, version: str, df: DataFrame, ranged: Sequence[str] = (), extra: Sequence[Column] = ()) -> tuple[Folder, dict]:
        """Write a folder; its entry for the manifest, and what was observed on the way: no second scan.

        The aggregates are taken by the tasks that write, each of which counts once.
        """
        rule, seen = self.constraints.get(name, Constraints()), Observation()
        indexed = {*ranged, *(c for s in self._indexes(name) for c in s)}
        typed = [f.name for f in df.schema if f.dataType.typeName() in ("date", "timestamp", "byte", "short", "integer", "long") or f.name in indexed and f.dataType.typeName() == "string"]
        taken = [*fingerprint(df.columns), *extra, *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"null {c}") for c in df.columns)]
        taken += [f(F.col(c)).alias(f"{k} {c}") for c in typed for k, f in (("low", F.min), ("high", F.max))]
        taken += [F.count_if(~F.coalesce(F.expr(c.condition), F.lit(True))).alias(f"check {c.name}") for c in rule.checks]
        df.observe(seen, *taken).write.parquet(f"{self.root}/versions/{version}/{name}")
        got = seen.get
        folder = {
            "version": version, "rows": got["rows"], "sum": got["sum"], "xor": got["xor"], "replaces": [], "nulls": {c: got[f"null {c}"] for c in df.columns if got[f"null {c}"]},
            "low": {c: _text(got[f"low {c}"]) for c in typed}, "high": {c: _text(got[f"high {c}"]) for c in typed},
        }
        return folder, got

    def _filtered(self, name: str, table: dict, sets: Sequence[Sequence[str]]) -> str:
        """The folder of the filters of a table's folders for these sets of columns; those that lack one get it now."""
        base = "filters/" + name + "/" + "+".join(keyfilter.index(s) for s in sets).replace(",", ".")
        there = self._names(base)
        for folder in table["folders"]:
            at = f"{base}/{folder['version']}"
            if folder["version"] in there and self._exists(f"{at}/_SUCCESS"):
                continue
            rows = self.spark.read.schema(_schema(table)).parquet(f"{self.root}/versions/{folder['version']}/{name}")
            keyfilter.build(rows, sets, folder["version"], folder["rows"]).write.mode("overwrite").parquet(f"{self.root}/{at}")
        return base

    def _candidates(self, name: str, table: dict, new: DataFrame, entry: Folder, sets: Sequence[Sequence[str]]) -> dict[str, list[str]]:
        """For each set of columns the versions of the folders that may hold a key of the new rows.

        Ranges are compared here; the filters of folders whose ranges meet are asked in one job.
        """
        asked = [(keyfilter.index(s), f["version"], f["rows"]) for s in sets for f in table["folders"] if f["rows"] and all(_meet(f, entry, c) for c in s)]
        if not asked or not entry["rows"]:
            return {}
        base = self._filtered(name, table, sets)
        filters = self.spark.read.schema(keyfilter.SCHEMA).parquet(*(f"{self.root}/{base}/{v}" for v in sorted({v for _, v, _ in asked})))
        hit = keyfilter.admitted(self.spark, filters, keyfilter.keys(new, sets), asked).select("index", "version").distinct().collect()  # a row for each set and folder
        return {i: sorted(r["version"] for r in hit if r["index"] == i) for i in {r["index"] for r in hit}}

    def _found(self, name: str, table: dict, new: DataFrame, columns: Sequence[str], versions: Sequence[str]) -> DataFrame:
        """Published rows, of these folders only, whose columns are among the new rows'."""
        return _among(self._read(name, table, versions), new, columns, "left_semi")

    def _unique(self, name: str, table: dict, new: DataFrame, sets: Sequence[Sequence[str]], hits: dict[str, list[str]]) -> DataFrame | None:
        """Rows of repeated keys in the table with the new rows, by constraint; only keys of new rows can repeat."""
        out = None
        for columns in sets:
            rows = new.select(*columns)
            if versions := hits.get(keyfilter.index(columns)):
                rows = rows.unionByName(self._found(name, table, new, columns, versions).select(*columns))
            n = rows.groupBy(*columns).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))
            part = n.select(F.lit(name).alias("table"), F.lit(f"unique {', '.join(columns)}").alias("constraint"), "rows")
            out = part if out is None else out.unionByName(part)
        return out

    def _observed(self, name: str, got: dict) -> list[tuple[str, str, int]]:
        """Violations that were counted while the rows were written."""
        rule = self.constraints.get(name, Constraints())
        return [(name, f"not null {c}", got[f"null {c}"]) for c in (*rule.required, *rule.key) if got[f"null {c}"]] + [(name, f"check {c.name}", got[f"check {c.name}"]) for c in rule.checks if got[f"check {c.name}"]]

    def _orphaned(self, before: dict[str, dict], after: dict[str, dict], written: set[str]) -> list[DataFrame]:
        """Checks of tables that stay as they are, against parents that are replaced and have lost a key."""
        lost: dict[tuple[str, str], bool] = {}
        out = []
        for name, rule in self.constraints.items():
            if name not in after or name in written:
                continue
            for f in rule.foreign:
                parent, target = f[1], f[2]
                if parent in written and parent in before and (parent, target) not in lost:
                    lost[parent, target] = not self._read(parent, before[parent]).select(target).subtract(self._read(parent, after[parent]).select(target)).isEmpty()
                if parent in written and lost.get((parent, target), True):
                    out.append(violations(name, self._read(name, after[name]), Constraints(foreign=[f]), {parent: self._read(parent, after[parent])}))
        return out

    def _refuse(self, observed: list[tuple[str, str, int]], asked: list[DataFrame]) -> None:
        rows = observed + ([tuple(r) for r in reduce(DataFrame.unionByName, asked).where("rows > 0").collect()] if asked else [])
        if rows:
            raise ConstraintError("; ".join(f"{t}: {c} ({n} rows)" for t, c, n in rows))

    def _logged(self, mode: str, work: Callable[[str, datetime.datetime], list[tuple]]) -> list[tuple]:
        run, started = uuid.uuid4().hex[:12], datetime.datetime.now(datetime.timezone.utc)
        try:
            rows = work(run, started)
        except ConflictError:
            raise
        except Exception as e:
            self._log([(run, "all", mode, None, None, None, started, (datetime.datetime.now(datetime.timezone.utc) - started).total_seconds() * 1000, "failed", str(e)[:500])])
            raise
        self._log(rows)
        return rows

    def refresh(self, tables: dict[str, DataFrame], mode: str = "full", keep: bool = False) -> DataFrame:
        """Publish all tables at once, or none: raises ConstraintError and logs the failure.

        With keep, the version's other tables stay as they are.
        """
        current = self._current()

        def work(run: str, started: datetime.datetime) -> list[tuple]:
            version, after, rows, observed = f"{time.time_ns()}", dict(current.tables) if keep else {}, [], []
            for name, df in tables.items():
                at = time.time()
                folder, got = self._write(name, version, df)
                observed += self._observed(name, got)
                before = _rows(after.get(name))
                after[name] = {"schema": df.schema.jsonValue(), "folders": [folder]}
                rows.append((run, name, mode, before, folder["rows"], folder["rows"], started, (time.time() - at) * 1000, "ok", None))
            staged = {n: self._read(n, t) for n, t in after.items()}
            asked = [violations(n, staged[n], replace(rule, required=(), checks=()), staged, nulls=False) for n, rule in self.constraints.items() if n in tables and (rule.key or rule.unique or rule.foreign)]
            self._refuse(observed, asked + self._orphaned(current.tables, after, set(tables)))
            self._publish(current, version, after)
            return rows

        return self.spark.createDataFrame(self._logged(mode, work), LOG)

    def load_incremental(
        self, facts: DataFrame, name: str = "fact_sales", key: Sequence[str] = ("receipt_id", "product_id"), watermark: str = "date_key",
        also: Callable[[DataFrame], dict[str, DataFrame]] | None = None, maintain: Callable[[Increment], dict[str, Change]] | None = None,
    ) -> tuple[int, int]:
        """Add the rows from the highest loaded watermark on whose key is new; (sent, inserted).

        Of rows sent with one key the smallest counts.  The new rows are a folder of their own in a
        new version.  also makes tables from all facts, maintain from what is added; they are
        published in the same version.  A load that another one overtakes starts again on its version.
        """
        for last in (False, False, True):
            try:
                return self._increment(facts, name, list(key), watermark, also, maintain)
            except ConflictError:
                if last:
                    raise
        raise AssertionError

    def _increment(self, facts, name, key, watermark, also, maintain) -> tuple[int, int]:
        current = self._current()
        table, done = current.tables[name], {}

        def work(run: str, started: datetime.datetime) -> list[tuple]:
            at, version, schema = time.time(), f"{time.time_ns()}", _schema(table)
            tops = [f["high"][watermark] for f in table["folders"] if watermark in f["high"] and f["high"][watermark] is not None]
            if not tops and _rows(table):  # a full load that did not keep the range of this column
                tops = [_text(self._read(name, table).agg(F.max(watermark)).first()[0])]
            sent = facts.where(F.col(watermark) >= F.lit(max(tops)).cast(schema[watermark].dataType)) if tops else facts
            sent = sent.groupBy(*key).agg(F.min(F.struct(*schema.names)).alias("_row"), F.count(F.lit(1)).alias("_n"))
            staged, counted = sent.select("_row.*", F.col("_n").alias("_sent")), Observation()
            sets = self._indexes(name, [key])
            entry, got = self._write(name, version, staged.observe(counted, F.coalesce(F.sum("_sent"), F.lit(0)).alias("sent")).drop("_sent"), [watermark])
            done["sent"] = counted.get["sent"]
            new = self.spark.read.schema(schema).parquet(f"{self.root}/versions/{version}/{name}")
            hits = self._candidates(name, table, new, entry, sets)
            if versions := hits.get(keyfilter.index(key)):
                fresh = _among(new, self._found(name, table, new, key, versions), key, "left_anti")
                version = f"{time.time_ns()}"
                entry, got = self._write(name, version, fresh, [watermark])
                new = self.spark.read.schema(schema).parquet(f"{self.root}/versions/{version}/{name}")
            done["added"] = entry["rows"]
            before = _rows(table)
            if not entry["rows"]:
                return [(run, name, "incremental", before, before, 0, started, (time.time() - at) * 1000, "ok", None)]
            after = dict(current.tables)
            after[name] = {"schema": table["schema"], "folders": [*table["folders"], entry]}
            rows = [(run, name, "incremental", before, before + entry["rows"], entry["rows"], started, (time.time() - at) * 1000, "ok", None)]
            observed, asked, added = self._observed(name, got), [], {name}

            def found(columns: Sequence[str]) -> DataFrame | None:
                versions = hits.get(keyfilter.index(columns))
                return self._found(name, table, new, columns, versions) if versions else None

            changes: dict[str, Change] = dict(also(self._read(name, after[name]))) if also else {}
            if maintain:
                changes |= maintain(Increment(new, lambda n: self._read(n, current.tables[n]), found))
            for other, change in changes.items():
                at, (df, replaced) = time.time(), change if isinstance(change, tuple) else (change, None)
                entry, got = self._write(other, version, df)
                was = _rows(after.get(other))
                if isinstance(change, tuple) and other in after:
                    if replaced is not None and not replaced.isEmpty():
                        replaced.distinct().write.parquet(f"{self.root}/versions/{version}/{other}-replaced")
                        entry["replaces"] = replaced.columns
                    after[other] = {"schema": after[other]["schema"], "folders": [*after[other]["folders"], entry]}
                    added.add(other)
                else:
                    after[other] = {"schema": df.schema.jsonValue(), "folders": [entry]}
                observed += self._observed(other, got)
                rows.append((run, other, "incremental", was, was + entry["rows"] if other in added else entry["rows"], entry["rows"], started, (time.time() - at) * 1000, "ok", None))
            staged = {n: self._read(n, t) for n, t in after.items()}
            if rule := self.constraints.get(name):
                unique = self._unique(name, table, new, [list(s) for s in (rule.key, *rule.unique) if s], hits)
                asked += [unique] if unique is not None else []
                asked += [violations(name, new, Constraints(foreign=rule.foreign), staged)] if rule.foreign else []
            for other in changes:
                if (rule := self.constraints.get(other)) and (rule.key or rule.unique or rule.foreign):
                    asked.append(violations(other, staged[other], replace(rule, required=(), checks=()), staged, nulls=False))
            self._refuse(observed, asked + self._orphaned(current.tables, after, {*changes, name}))
            self._filtered(name, {"schema": table["schema"], "folders": [after[name]["folders"][-1]]}, sets)
            self._publish(current, version, after)
            return rows

        self._logged("incremental", work)
        return done["sent"], done["added"]

    def compact(self, name: str, most: int = 1) -> bool:
        """One folder instead of more than `most`; what replaced rows held is gone for good."""
        current = self._current()
        table = current.tables[name]
        if len(table["folders"]) <= most:
            return False
        version = f"{time.time_ns()}"
        ranged = sorted({c for f in table["folders"] for c in f["low"]})
        folder, _ = self._write(name, version, self._read(name, table), ranged)
        self._publish(current, version, current.tables | {name: {"schema": table["schema"], "folders": [folder]}})
        return True

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete what the last versions don't name; loads that run meanwhile keep their folders."""
        files = sorted(n for n in self._names("manifest") if n.endswith(".json"))
        kept = [c for n in files[-keep:] if (c := self._content(f"manifest/{n}"))]
        if not kept:
            return []
        named = {f["version"] for c in kept for t in c["tables"].values() for f in t["folders"]}
        gone = sorted(v for v in self._names("versions") if v not in named and v < max(c["version"] for c in kept))
        for n in files[:-keep]:
            self._delete(f"manifest/{n}")
        for v in gone:
            self._delete(f"versions/{v}")
        for name in self._names("filters"):
            for kind in self._names(f"filters/{name}"):
                for v in set(self._names(f"filters/{name}/{kind}")) & set(gone):
                    self._delete(f"filters/{name}/{kind}/{v}")
        return gone

    def verify(self, sources: dict[str, DataFrame] | None = None) -> DataFrame:
        """What is loaded against its sources: rows, nulls of each column, a fingerprint of all rows, turnover, daily turnover, constraints, personal columns, duration.

        Without sources, against what was observed when the tables were written.  Each table is read
        once for all of its figures.
        """
        current = self._current()
        names = sorted(sources) if sources is not None else sorted(current.tables)
        loaded = {n: self._read(n, current.tables[n]) for n in names}
        money = lambda n: [F.coalesce(F.sum("line_total"), F.lit(0.0)).alias("turnover")] if n == "fact_sales" else []
        rows: list[tuple[str, float, float, bool]] = []
        near = lambda what, a, b: rows.append((what, float(a), float(b), abs(float(a) - float(b)) < 0.01))
        for n in names:
            columns = _schema(current.tables[n]).names
            figures = lambda df: df.agg(*fingerprint(columns), *money(n), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"null {c}") for c in columns)).first().asDict()  # noqa: B023, E731
            b = figures(loaded[n])
            if sources is not None:
                a = figures(sources[n].select(*columns))
            else:
                parts = current.tables[n]["folders"]
                if any(p["replaces"] for p in parts):
                    continue  # its rows are fewer than those written
                a = b | {"rows": sum(p["rows"] for p in parts), "sum": str(sum(int(p["sum"]) for p in parts)), "xor": str(reduce(lambda x, y: x ^ int(y["xor"]), parts, 0))}
                a |= {f"null {c}": sum(p["nulls"].get(c, 0) for p in parts) for c in columns}
            near(f"rows {n}", a["rows"], b["rows"])
            rows.append((f"content {n}", float(int(a["sum"]) % 1_000_003), float(int(b["sum"]) % 1_000_003), (a["sum"], a["xor"]) == (b["sum"], b["xor"])))
            for c in columns:
                if a[f"null {c}"] or b[f"null {c}"]:
                    near(f"nulls {n}.{c}", a[f"null {c}"], b[f"null {c}"])
            if money(n):
                near("turnover", a["turnover"], b["turnover"])
        if "agg_daily" in loaded and "fact_sales" in loaded:
            by_day = loaded["fact_sales"].groupBy(F.col("branch_id").alias("branch"), "date_key").agg(F.sum("line_total").alias("_t"))
            near("days off", 0, loaded["agg_daily"].join(by_day, ["branch", "date_key"], "left").where("not data_missing and abs(coalesce(revenue, 0) - coalesce(_t, 0)) > 0.01").count())
        asked = [violations(n, loaded[n], rule, loaded) for n, rule in self.constraints.items() if n in loaded and all(f[1] in loaded for f in rule.foreign)]
        if asked:
            for r in reduce(DataFrame.unionByName, asked).collect():
                near(f"{r['table']}: {r['constraint']}", 0, r["rows"])
        if "dim_member" in loaded:
            near("personal columns", 0, len({"full_name", "phone"} & set(loaded["dim_member"].columns)))
        took = self.log().where(F.col("status") == "ok").agg(F.coalesce(F.sum("duration_ms"), F.lit(0.0))).first()[0]
        near("load milliseconds", took, took)
        return self.spark.createDataFrame(rows, "check string, expected double, found double, passed boolean")

    def views(self) -> None:
        """Temporary views of all tables, and v_sales_enriched over the star."""
        for n, table in self._current().tables.items():
            self._read(n, table).createOrReplaceTempView(n)
        self.spark.sql("""
            CREATE OR REPLACE TEMP VIEW v_sales_enriched AS
            SELECT f.*, d.date, d.month, d.day_name, d.is_weekend, d.is_holiday, d.holiday_name, b.name_th AS branch_name,
                   p.name_th AS product_name, p.category, m.age_group, m.gender, m.spend_tier
            FROM fact_sales f JOIN dim_date d ON f.date_key = d.date_key JOIN dim_branch b ON f.branch_id = b.branch_id
            JOIN dim_product p ON f.product_id = p.product_id LEFT JOIN dim_member m ON f.member_id = m.member_id""")
