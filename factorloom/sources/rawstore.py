"""Raw tables that outlive a session: month parts under one folder, and manifests that say which parts are current.

A table is a folder:

* ``data-<id>/__part=<month>/``: files that one write has made, one folder for
  each month of the table's date (``all`` for a table without one);
* ``manifest/v=<n>/``: version n, a row per part with the folder that holds it.

A write makes new files for the months that it touches, then adds a manifest in
which only these months point elsewhere. Until that last step, a rename of one
file, readers have the version before, and a write that dies has changed
nothing. Files of other months are not written again. One writer at a time
works on a table; readers may be many. Any folder that Spark can write will do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.sources import store

_MANIFEST = "part string, path string, row_count long"
_ALL, _NONE = "all", "none"


class RawStore:
    """The raw tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str, dates: dict[str, str] | None = None):
        """``dates``: timestamp columns by whose month tables beyond the raw ones are stored."""
        self.spark, self.root, self.dates = spark, root.rstrip("/"), dates or {}
        self._seen: dict[tuple[str, int], list] = {}  # manifests do not change

    # Versions

    def version(self, name: str) -> int:
        """The current version, 0 if there is no such table: the last manifest that was written whole."""
        fs, at = self._fs(f"{self.root}/{name}/manifest")
        if not fs.exists(at):
            return 0
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("v=")]
        numbers = sorted((int(p.getName()[2:]) for p in found), reverse=True)
        return next((n for n in numbers if fs.exists(path(f"{self.root}/{name}/manifest/v={n}/_SUCCESS"))), 0)

    def _manifest(self, name: str, version: int | None = None) -> list:
        version = self.version(name) if version is None else version
        if version and (name, version) not in self._seen:
            self._seen[name, version] = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/{name}/manifest/v={version}").collect()  # one row per month
        return self._seen.get((name, version), [])

    def parts(self, name: str, version: int | None = None) -> dict[str, tuple[str, int]]:
        """Folder and number of rows of each part of a version (the current one by default)."""
        return {r.part: (r.path, r.row_count) for r in self._manifest(name, version) if r.part is not None}

    def exists(self, name: str) -> bool:
        """A dropped table's last manifest has no parts and says so."""
        rows = self._manifest(name)
        return bool(rows) and rows[0].path != "dropped"

    def names(self) -> list[str]:
        """All tables under the folder, those of no known name too."""
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        return sorted(n for n in found if self.exists(n))

    def _commit(self, name: str, parts: dict[str, tuple[str, int]], before: int, note: str | None = None) -> None:
        if self.version(name) != before:
            raise RuntimeError(f"{name} was written by someone else meanwhile")
        rows = [(p, *v) for p, v in sorted(parts.items())] or [(None, note or "empty", 0)]
        frame = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.root}/{name}/manifest/v={before + 1}")  # what a dead write left there is no version

    # Reading

    def _schema(self, name: str) -> str | None:
        return store.table_schema(name) if name in store.COLUMNS else None

    def _load(self, name: str, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self._schema(name)) if self._schema(name) else self.spark.read
        if not paths:
            return self.spark.createDataFrame([], self._schema(name) or "nothing string")
        return reader.parquet(*[f"{self.root}/{name}/{p}" for p in paths])

    def read(self, name: str, start: str | None = None, end: str | None = None, version: int | None = None) -> DataFrame:
        """A table, or its months between two dates (``YYYYMMDD``, rows of these months only come whole: filter them too)."""
        if not self.exists(name):
            raise ValueError(f"no table {name} under {self.root}")
        low, high = (start or "").replace("-", "")[:6], (end or "9").replace("-", "")[:6]
        parts = self.parts(name, version)
        kept = [path for part, (path, _) in parts.items() if part == _ALL or (part == _NONE and not (start or end)) or (part != _NONE and low <= part <= high)]
        return self._load(name, sorted(kept))

    def register(self, names: list[str] | None = None) -> list[str]:
        """Make the tables that exist known to the session by their names."""
        found = [n for n in (self.names() if names is None else names) if self.exists(n)]
        for n in found:
            self.read(n).createOrReplaceTempView(n)
        return found

    # Writing

    def _part(self, name: str):
        if name in self.dates:
            return F.coalesce(F.date_format(self.dates[name], "yyyyMM"), F.lit(_NONE))
        date = store.DATES.get(name)
        if date is None or date not in (store.COLUMNS.get(name) or date).split():
            return F.lit(_ALL)
        day = F.col(date).cast("string")
        return F.when(day.rlike(r"^\d{8}$"), F.substring(day, 1, 6)).otherwise(_NONE)

    def _write(self, name: str, rows: DataFrame) -> dict[str, tuple[str, int]]:
        """New files of ``rows`` by part."""
        folder = f"data-{uuid.uuid4().hex}"
        path = f"{self.root}/{name}/{folder}"
        rows.withColumn("__part", self._part(name)).hint("rebalance", "__part").write.partitionBy("__part").parquet(path)
        if rows.schema.names and not self._has_files(path):
            return {}
        text = self.spark.read.schema(f"{store.table_schema(name) + ', ' if self._schema(name) else ''}__part string").parquet(path)
        counts = text.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per month
        return {r["__part"]: (f"{folder}/__part={r['__part']}", r.n) for r in counts}

    def replace(self, name: str, rows: DataFrame) -> None:
        """All rows anew. ``rows`` may read the table itself: its files stay."""
        before = self.version(name)
        if name in store.COLUMNS:
            rows = store.fitted(rows, self.spark.createDataFrame([], store.table_schema(name)))
        self._commit(name, self._write(name, rows), before)

    def create_missing(self, names=tuple(store.COLUMNS)) -> list[str]:
        """Empty tables of the known names that do not exist."""
        made = [n for n in names if not self.exists(n)]
        for n in made:
            self._commit(n, {}, self.version(n))
        return made

    def upsert(self, name: str, incoming: DataFrame) -> list[str]:
        """Incoming rows in place of those of their keys; the months that were written anew.

        A table's keys hold its date, so rows of one key are of one month. Null
        or odd dates have a part of their own. Other months' files are not read.
        """
        self.create_missing([name])
        before, parts = self.version(name), self.parts(name)
        empty = self.spark.createDataFrame([], store.table_schema(name))
        new = store.fitted(incoming, empty)
        touched = sorted(r[0] for r in new.select(self._part(name)).distinct().collect())  # one row per month
        if not touched:
            return []
        now = self._load(name, [parts[m][0] for m in touched if m in parts])
        written = self._write(name, store.upsert(now, new, store.KEYS[name]))
        self._commit(name, parts | written, before)
        return touched

    def replace_from(self, name: str, rows: DataFrame, month: str) -> None:
        """``rows``, all of ``month`` (``YYYYMM``) or later, in place of what the table has from that month on."""
        before = self.version(name)
        kept = {m: p for m, p in self.parts(name).items() if m < month or m in (_ALL, _NONE)}
        self._commit(name, kept | self._write(name, rows), before)

    def drop(self, name: str) -> None:
        """The table is gone for readers; ``vacuum`` removes its files."""
        self._commit(name, {}, self.version(name), "dropped")

    # Files

    def _fs(self, path: str | None = None):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path or self.root)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _has_files(self, path: str) -> bool:
        fs, at = self._fs(path)
        return any(s.isDirectory() for s in fs.listStatus(at))

    def vacuum(self, name: str) -> list[str]:
        """Remove the folders of data that no part of the current version is in, and older manifests; their names.

        Readers that began before keep what they have open only; call it when there are none.
        """
        fs, at = self._fs(f"{self.root}/{name}")
        version = self.version(name)
        used = {path.split("/")[0] for path, _ in self.parts(name).values()}
        jvm = self.spark.sparkContext._jvm
        gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in used]
        manifests = fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/manifest"))
        gone += [s.getPath() for s in manifests if s.isDirectory() and s.getPath().getName() != f"v={version}"]
        for path in gone:
            fs.delete(path, True)
        return sorted(p.getName() for p in gone)


def update_raw(tables: RawStore, incoming: dict[str, DataFrame]) -> dict[str, tuple[dict, dict]]:
    """Upsert each table (``stock_basic`` is replaced); status before and after by table."""
    report = {}
    tables.create_missing(list(incoming))
    for name, rows in incoming.items():
        column = store.DATES[name] or "list_date"
        before = store.status(tables.read(name), column).head().asDict()
        if name == "stock_basic":
            tables.replace(name, rows)
        else:
            tables.upsert(name, rows)
        report[name] = (before, store.status(tables.read(name), column).head().asDict())
    return report


def rebuild_filings(tables: RawStore, incoming: DataFrame | None = None, limit_stocks: int | None = None) -> dict[str, tuple[dict, dict]]:
    """The cleaned filings from the raw ones, which ``incoming`` replaces where given; status of both before and after.

    ``limit_stocks``: only the first so many codes of the master data.
    """
    names = ("fina_indicator_raw_v2", "fina_indicator_clean")
    tables.create_missing(names)
    state = lambda: {n: store.status(tables.read(n), "ann_date").head().asDict() for n in names}
    before = state()
    if incoming is not None:
        if limit_stocks is not None:
            codes = tables.read("stock_basic").select("ts_code").where("ts_code is not null").distinct().orderBy("ts_code").limit(limit_stocks)
            incoming = incoming.join(codes, "ts_code", "left_semi")
        raw = tables.spark.createDataFrame([], store.table_schema(names[0]))
        tables.replace(names[0], store.upsert(raw, incoming, store.KEYS[names[0]]))
    tables.replace(names[1], store.clean_filings(tables.read(names[0])))
    after = state()
    return {n: (before[n], after[n]) for n in names}


def prune_plan(tables: RawStore, keep: dict[str, str], drop: dict[str, str]) -> list[store.PruneItem]:
    """keep, drop or review for every table of the store, by two lists of reasons."""
    plan = []
    for name in tables.names():
        rows = sum(n for _, n in tables.parts(name).values())
        if name in keep:
            plan.append(store.PruneItem(name, "keep", keep[name], rows))
        elif name in drop:
            plan.append(store.PruneItem(name, "drop", drop[name], rows))
        else:
            plan.append(store.PruneItem(name, "review", "in neither list; look at it before any deletion", rows))
    return plan


def prune(tables: RawStore, plan: list[store.PruneItem], execute: bool = False) -> list[str]:
    """Names of the tables to drop; they and their files go only if ``execute``."""
    names = [p.table for p in plan if p.action == "drop"]
    for n in names if execute else []:
        tables.drop(n)
        tables.vacuum(n)
    return names
