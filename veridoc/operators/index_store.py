"""An index that takes in changed documents without rewriting the rest: runs of rows, newest first, merged level by level.

A batch writes one run: the new rows of its documents, and a mark for every document it touched, which hides that document's
rows in older runs (a touched document without rows is gone).  Two runs of a level are merged into one of the next, so a row
is rewritten once a level and a reader meets few runs.  A run counts only once the manifest names it; the manifest is written
last, as a whole new version, so a job that is broken off leaves no visible row and can be run again, and a batch that is in
already is left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "level int, first long, last long, version long"
Run = tuple[int, int, int]  # level, first batch, last batch


class IndexStore:
    """Rows below ``path``, a folder that driver and executors share; ``key`` names a row's document."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path, key

    def _manifest(self) -> tuple[int, list[Run]]:
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect()  # a few rows for each version
        except AnalysisException:
            return -1, []
        newest = max((r["version"] for r in rows), default=-1)
        return newest, sorted((tuple(r)[:3] for r in rows if r["version"] == newest), key=lambda r: r[1])

    def runs(self) -> list[Run]:
        """The runs that count, oldest first."""
        return self._manifest()[1]

    def _folder(self, run: Run, what: str) -> str:
        return f"{self.path}/{what}-{run[0]}-{run[1]}-{run[2]}"

    def _load(self, run: Run, what: str) -> DataFrame:
        return self.spark.read.parquet(self._folder(run, what))

    def _write(self, run: Run, rows: DataFrame, touched: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._folder(run, "rows"))
        touched.write.mode("overwrite").parquet(self._folder(run, "touched"))

    def _commit(self, runs: list[Run]) -> None:
        version = self._manifest()[0] + 1
        rows = self.spark.createDataFrame(runs, "level int, first long, last long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def apply(self, rows: DataFrame, touched: DataFrame, batch: int) -> None:
        """Take in batch ``batch`` (numbered from 0): ``touched`` (key) documents now have ``rows`` and no others."""
        runs = self.runs()
        if runs and batch <= runs[-1][2]:
            return
        run = (0, batch, batch)
        self._write(run, rows, touched.select(self.key).distinct())
        self._commit([*runs, run])
        self._merge()

    def _merge(self) -> None:
        while len(runs := self.runs()) > 1 and runs[-1][0] == runs[-2][0]:
            old, new = runs[-2:]
            both = (new[0] + 1, old[1], new[2])
            rows, touched = self._live([old, new]), self._load(old, "touched").unionByName(self._load(new, "touched")).distinct()
            if len(runs) == 2:  # nothing older is left to hide
                touched = touched.join(rows.select(self.key).distinct(), self.key, "left_semi")
            self._write(both, rows, touched)
            self._commit([*runs[:-2], both])

    def _live(self, runs: list[Run]) -> DataFrame:
        """Rows of the runs, oldest first, without those of documents that a newer run touched."""
        parts = []
        for i, run in enumerate(runs):
            newer = [self._load(r, "touched") for r in runs[i + 1 :]]
            rows = self._load(run, "rows")
            parts.append(rows.join(reduce(DataFrame.unionByName, newer).distinct(), self.key, "left_anti") if newer else rows)
        return reduce(DataFrame.unionByName, parts)

    def read(self) -> DataFrame:
        """All live rows."""
        return self._live(self.runs())
