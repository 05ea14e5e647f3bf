"""Refreshes in named steps: tables in versions, a ledger of steps, and restart from where a run stopped.

Each step writes one table as Parquet into the folder of its run, and then its line in the ledger, so a line stands for a whole
table. When all steps are done, one manifest that names the tables of the version is put in place by renaming it, which a file
system does at once or not at all. Readers go by the newest manifest: they never see a part of a version, and keep theirs while
the next one is made. A run that is started again skips the steps in its ledger, or begins at a step that is named.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Step = tuple[str, Callable[[Callable[[str], DataFrame]], DataFrame]]


class Versions:
    """The versions below a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _put(self, path: str, value: dict) -> None:
        """Write a small file under another name, then give it its own: it is there whole or not at all."""
        fs, to = self._at(path)
        _, made = self._at(path + ".tmp")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if not fs.rename(made, to):
            raise FileExistsError(f"{self.root}/{path}")

    def _files(self, path: str) -> dict[str, dict]:
        """The small files of a folder by name."""
        fs, where = self._at(path)
        if not fs.exists(where):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        rows = {n: self.spark.read.text(f"{self.root}/{path}/{n}", wholetext=True).first()[0] for n in names if n.endswith(".json")}
        return {n.removesuffix(".json"): json.loads(v) for n, v in rows.items()}

    def manifest(self) -> dict:
        """The newest published version; number 0 without tables if there is none."""
        known = self._files("manifests")
        return max(known.values(), key=lambda m: m["version"], default={"version": 0, "tables": {}})

    def read(self, table: str, manifest: dict | None = None) -> DataFrame:
        """A table of the newest version, or of one that was asked for before."""
        return self.spark.read.parquet(f"{self.root}/{(manifest or self.manifest())['tables'][table]}")

    def ledger(self, run: str) -> dict[str, dict]:
        """What a run has done, by step."""
        return self._files(f"runs/{run}/ledger")

    def refresh(self, run: str, steps: list[Step], start: str | None = None) -> dict:
        """Do the steps (name, function of a reader of tables) in order and publish. Steps read tables of this run that are
        done, else those of the last version. ``start`` names the step from which all are done again."""
        names, before = [n for n, _ in steps], self.manifest()
        if before.get("run") == run and start is None:
            return before
        if start is not None and start not in names:
            raise ValueError(f"no step {start}")
        done = self.ledger(run)
        for name in names[names.index(start) :] if start is not None else ():
            fs, line = self._at(f"runs/{run}/ledger/{name}.json")
            fs.delete(line, False)
            done.pop(name, None)
        for place, (name, step) in enumerate(steps):
            if name in done:
                continue
            known = before["tables"] | {n: line["table"] for n, line in done.items()}
            attempt = len(self._tries(run, name))
            table = f"runs/{run}/tables/{name}/{attempt}"  # what an attempt left behind is never read
            step(lambda t, known=known: self.spark.read.parquet(f"{self.root}/{known[t]}")).write.parquet(f"{self.root}/{table}")
            rows = self.spark.read.parquet(f"{self.root}/{table}").count()
            done[name] = {"step": name, "place": place, "table": table, "rows": rows}
            self._put(f"runs/{run}/ledger/{name}.json", done[name])
        made = {"version": before["version"] + 1, "run": run, "tables": before["tables"] | {n: done[n]["table"] for n in names}}
        self._put(f"manifests/{made['version']:08d}.json", made)
        return made

    def _tries(self, run: str, name: str) -> list[str]:
        fs, where = self._at(f"runs/{run}/tables/{name}")
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
