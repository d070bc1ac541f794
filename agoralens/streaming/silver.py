"""Silver tables of a stream: batches behind a manifest, closed ones compacted.

A batch writes a folder to each table and becomes visible in all of them at once,
when the next version of the manifest takes its name. Batches are known by their
query and number, so that another checkpoint on the same root adds to it, and a
batch that is replayed finds itself there. Every FAN closed batches of a query
become one folder, every FAN of those one larger, and so on: a read lists a number
of folders that grows with the logarithm of the batches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from agoralens.sources import files

#: Entries that are merged into one, and versions for which replaced folders and old manifests are kept for readers.
FAN = 16
KEEP = 8


@dataclass(frozen=True)
class Entry:
    """Batches `first` to `last` of a query, in one folder a table; its rows are numbered from `start`."""

    query: str
    first: int
    last: int
    tier: int
    folder: str
    start: int
    rows: int


@dataclass(frozen=True)
class Manifest:
    version: int = -1
    entries: tuple[Entry, ...] = ()
    #: Folders that are no longer read, with the version that replaced them.
    retired: tuple[tuple[str, int], ...] = field(default=())

    def batch(self, query: str, number: int) -> Entry | None:
        return next((e for e in self.entries if e.query == query and e.first <= number <= e.last), None)

    @property
    def end(self) -> int:
        """The number that the next row gets."""
        return max((e.start + e.rows for e in self.entries), default=0)

    def query(self, name: str | None) -> str:
        """`name`, or the only query that has written so far."""
        known = {e.query for e in self.entries}
        return name or (known.pop() if len(known) == 1 else "direct")


def _log(root: str) -> str:
    return f"{root}/_manifest"


def latest(spark: SparkSession, root: str) -> Manifest:
    versions = [n for n in files.names(spark, _log(root)) if n.endswith(".json")]
    if not versions:
        return Manifest()
    stored = json.loads(files.read_text(spark, f"{_log(root)}/{versions[-1]}"))
    return Manifest(stored["version"], tuple(Entry(**e) for e in stored["entries"]), tuple(map(tuple, stored["retired"])))


def _switch(spark: SparkSession, root: str, tables: list[str], old: Manifest, entries: list[Entry], replaced: list[str]) -> bool:
    """Make `entries` the next version; false if another writer was first. What readers can't need any more is deleted."""
    version = old.version + 1
    gone = [f for f, v in old.retired if v <= version - KEEP]
    retired = [(f, v) for f, v in old.retired if v > version - KEEP] + [(f, version) for f in replaced]
    text = json.dumps({"version": version, "entries": [asdict(e) for e in entries], "retired": retired})
    if not files.write_new(spark, f"{_log(root)}/{version:020d}.json", text):
        return False
    for folder in gone:
        for table in tables:
            files.delete(spark, f"{root}/{table}/{folder}")
    if version >= KEEP:
        files.delete(spark, f"{_log(root)}/{version - KEEP:020d}.json")
    return True


def append(spark: SparkSession, root: str, query: str | None, batch: int, tables: list[str], write: Callable[[str, int], int]) -> bool:
    """Write a batch and show it; false if it was there already, and nothing is done.

    `write` gets a folder name and the number of the first row, writes the folder
    in each of `tables` and returns the number of rows. It is called again only if
    another writer showed a batch meanwhile, which moves the numbers.
    """
    while True:
        seen = latest(spark, root)
        name = seen.query(query)
        if seen.batch(name, batch):
            return False
        folder = f"{batch:010d}-{uuid.uuid4().hex}"
        rows = write(folder, seen.end)
        entry = Entry(name, batch, batch, 0, folder, seen.end, rows)
        if _switch(spark, root, tables, seen, [*seen.entries, entry], []):
            return True
        for table in tables:
            files.delete(spark, f"{root}/{table}/{folder}")


def due(entries: tuple[Entry, ...]) -> list[Entry]:
    """The oldest FAN entries of one query and tier, if there are so many."""
    by: dict[tuple[str, int], list[Entry]] = {}
    for e in sorted(entries, key=lambda e: e.first):
        by.setdefault((e.query, e.tier), []).append(e)
    return next((run[:FAN] for _, run in sorted(by.items(), key=lambda x: x[0][1]) if len(run) >= FAN), [])


def compact(spark: SparkSession, root: str, merges: dict[str, Callable[[DataFrame], DataFrame]], fmt: str) -> int:
    """Merge closed batches until none are due; how many merges were made.

    `merges` has for each table what becomes of the rows of several batches. A
    crash before the switch leaves a folder that nothing reads.
    """
    made = 0
    while run := due((seen := latest(spark, root)).entries):
        folder = f"{run[0].first:010d}-{uuid.uuid4().hex}"
        for table, merge in merges.items():
            rows = read(spark, root, table, fmt, run)
            merge(rows).hint("rebalance").write.format(fmt).save(f"{root}/{table}/{folder}")
        start, n = min(e.start for e in run), sum(e.rows for e in run)
        merged = Entry(run[0].query, run[0].first, run[-1].last, run[0].tier + 1, folder, start, n)
        rest = [e for e in seen.entries if e not in run]
        if _switch(spark, root, list(merges), seen, [*rest, merged], [e.folder for e in run]):
            made += 1
        else:
            for table in merges:
                files.delete(spark, f"{root}/{table}/{folder}")
    return made


def read(spark: SparkSession, root: str, table: str, fmt: str = "parquet", entries: list[Entry] | None = None) -> DataFrame:
    """The rows of a table: those of the batches in one version of the manifest."""
    entries = latest(spark, root).entries if entries is None else entries
    if not entries:
        raise FileNotFoundError(f"no batch has been written to {root}")
    return spark.read.format(fmt).load([f"{root}/{table}/{e.folder}" for e in entries])
