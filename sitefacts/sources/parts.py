"""Stored rows in parts by a hash of their key, with a manifest that names the folders in use.

A commit writes new folders and then one small manifest; folders that no manifest names are not there for
any reader, so a run that is killed leaves the state before it. Folders of a part are merged by level: as
soon as ``most`` of one level have come together they become one of the next, so a part has at most
``most - 1`` folders a level, and a row is rewritten once per level and not once per commit.

Manifests older than the newest ``keep`` go, with the folders that only they name. A reader that is more
than ``keep`` commits behind has to load again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "key_part"
Folder = tuple[str, int]


class StoreConflict(RuntimeError):
    """Another run has committed the same version."""


@dataclass
class Manifest:
    """The folders (path below the root, level) of each part at one version; version -1 is before any commit."""

    version: int = -1
    n_parts: int = 0
    parts: dict[int, list[Folder]] = field(default_factory=dict)

    def folders(self, parts: Iterable[int] | None = None) -> list[str]:
        chosen = self.parts if parts is None else [p for p in parts if p in self.parts]
        return [path for p in sorted(chosen) for path, _ in self.parts[p]]


class PartStore:
    """A store below ``root``; ``n_parts`` counts when the store is made and is kept from then on."""

    def __init__(self, spark: SparkSession, root: str, n_parts: int = 64, most: int = 8, keep: int = 8):
        self.spark, self.root, self.n_parts, self.most, self.keep = spark, root.rstrip("/"), n_parts, most, keep
        self.jvm = spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    # manifests

    def versions(self) -> list[int]:
        found = self.fs.globStatus(self.path("manifests/*.json")) or []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in found)

    def load(self, version: int) -> Manifest:
        stream = self.fs.open(self.path(f"manifests/{version:012d}.json"))
        try:
            said = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(version, said["n_parts"], {int(p): [tuple(x) for x in v] for p, v in said["parts"].items()})

    def current(self, before: int | None = None) -> Manifest:
        """The newest state, or the newest below a version: what a replayed batch has to start from."""
        found = [v for v in self.versions() if before is None or v < before]
        return self.load(found[-1]) if found else Manifest(-1, self.n_parts)

    def commit(self, made: Manifest, replay: bool = False) -> None:
        """Makes a state the current one. A version that exists is a conflict, unless a batch is replayed."""
        target = self.path(f"manifests/{made.version:012d}.json")
        if self.fs.exists(target):
            if not replay:
                raise StoreConflict(f"version {made.version} of {self.root} exists")
            self.fs.delete(target, False)
        staged = self.path(f"manifests/{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(staged, True)
        try:
            stream.write(bytearray(json.dumps({"n_parts": made.n_parts, "parts": made.parts}).encode()))
        finally:
            stream.close()
        if not self.fs.rename(staged, target):
            self.fs.delete(staged, False)
            raise StoreConflict(f"version {made.version} of {self.root} exists")
        self.prune()

    def prune(self) -> None:
        """Drops manifests beyond the newest ``keep``, and the folders that only they name."""
        found = self.versions()
        old, kept = found[: -self.keep], found[-self.keep :]
        if not old:
            return
        used = {f for v in kept for f in self.load(v).folders()}
        for version in old:
            for folder in set(self.load(version).folders()) - used:
                self.fs.delete(self.path(folder), True)
            self.fs.delete(self.path(f"manifests/{version:012d}.json"), False)

    # rows

    def part_of(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.current().n_parts)).cast("int").alias(PART)

    def read(self, schema: StructType | str, state: Manifest | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        folders = (state or self.current()).folders(parts)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def write(self, rows: DataFrame, order: Sequence[str] = ()) -> dict[int, str]:
        """Writes rows with a column PART to new folders, files sorted by ``order``; gives the folder of each part that has rows."""
        name = f"data/{uuid.uuid4().hex}"
        rows = rows.hint("rebalance", F.col(PART))
        rows = rows.sortWithinPartitions(PART, *order) if order else rows
        rows.write.partitionBy(PART).parquet(f"{self.root}/{name}")
        made = self.fs.globStatus(self.path(f"{name}/{PART}=*")) or []
        return {int(p.rpartition("=")[2]): f"{name}/{p}" for p in (s.getPath().getName() for s in made)}

    def append(self, rows: DataFrame, state: Manifest, version: int, fold: Callable[[DataFrame], DataFrame] | None = None, order: Sequence[str] = (), replay: bool = True) -> Manifest:
        """Commits ``state`` and the rows (with a column PART) as ``version``; replaying a version gives the same state.

        Without ``replay`` a version that exists is a conflict.

        Parts whose folders have to be merged are read and written with their new rows; ``fold`` may
        combine the rows of such a part, PART included.
        """
        merged: dict[int, tuple[list[Folder], int]] = {}
        for part, folders in state.parts.items():
            level, taken = 0, []
            while len(here := [f for f in folders if f[1] == level]) + bool(taken) >= self.most:
                taken, level = taken + here, level + 1
            if taken:
                merged[part] = (taken, level)
        own = [c for c in rows.columns if c != PART]
        if merged:
            rows = self._with_merged(rows, own, merged, fold)
        written = self.write(rows, order)
        parts = dict(state.parts)
        for part, (taken, _) in merged.items():
            parts[part] = [f for f in parts[part] if f not in taken]
        for part, folder in written.items():
            parts[part] = [*parts.get(part, []), (folder, merged[part][1] if part in merged else 0)]
        made = Manifest(version, state.n_parts, {p: v for p, v in parts.items() if v})
        self.commit(made, replay)
        return made

    def _with_merged(self, rows: DataFrame, own: list[str], merged: dict[int, tuple[list[Folder], int]], fold) -> DataFrame:
        schema = rows.select(*own).schema
        paths = [f"{self.root}/{folder}" for taken, _ in merged.values() for folder, _ in taken]
        # the part is in the folder's name
        of_path = F.regexp_extract("_metadata.file_path", f"/{PART}=([0-9]+)/", 1).cast("int").alias(PART)
        old = self.spark.read.schema(schema).parquet(*paths).select(*own, of_path)
        if fold is None:
            return rows.unionByName(old)
        here = F.col(PART).isin(*merged)
        return rows.where(~here).unionByName(fold(rows.where(here).unionByName(old)).select(*rows.columns))

    def replace(self, rows: DataFrame, state: Manifest, parts: Iterable[int]) -> Manifest:
        """Commits ``state`` with the given parts made of ``rows`` alone, as the next version."""
        written = self.write(rows)
        kept = {p: v for p, v in state.parts.items() if p not in set(parts)}
        made = Manifest(state.version + 1, state.n_parts, {**kept, **{p: [(f, 0)] for p, f in written.items()}})
        self.commit(made)
        return made
