"""Matching jobs that run in the foreground or background, with progress, results, statistics and exports."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import results
from ..sources import export as files
from .engine import ColumnPair, match_columns, match_multi


class MatchJob:
    """One matching run; its result is a written table, so that nothing is computed twice or held in memory."""

    def __init__(self, df: DataFrame, path: str, plan: Callable[[DataFrame], DataFrame], names: tuple[str, str]):
        self.spark, self.df, self.path, self.plan, self.names = df.sparkSession, df, path, plan, names
        self.id = uuid.uuid4().hex
        self.status, self.error = "pending", None
        self._thread: threading.Thread | None = None

    @classmethod
    def columns(cls, df: DataFrame, path: str, col_a: str, col_b: str, matching_type: str = "auto", **options) -> MatchJob:
        return cls(df, path, lambda d: match_columns(d, col_a, col_b, matching_type, **options), (col_a, col_b))

    @classmethod
    def multi(cls, df: DataFrame, path: str, pairs: list[ColumnPair], **options) -> MatchJob:
        return cls(df, path, lambda d: match_multi(d, pairs, **options), ("Multi_A", "Multi_B"))

    def run(self) -> MatchJob:
        """Run here and now; an error is kept and raised."""
        self.status = "running"
        self.spark.sparkContext.setJobGroup(self.id, f"matching {' and '.join(self.names)}", True)
        try:
            df = self.df if "row_id" in self.df.columns else results.with_row_id(self.df)
            self.plan(df).write.mode("overwrite").parquet(self.path)
            self.status = "completed"
        except Exception as e:
            self.status, self.error = "failed", str(e)
            raise
        return self

    def start(self) -> MatchJob:
        """Run in a thread; wait() ends with it."""
        from pyspark import inheritable_thread_target

        def target():
            try:
                self.run()
            except Exception:
                pass  # status and error tell

        self.status = "running"
        self._thread = threading.Thread(target=inheritable_thread_target(target), daemon=True)
        self._thread.start()
        return self

    def wait(self, seconds: float | None = None) -> str:
        if self._thread:
            self._thread.join(seconds)
        return self.status

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobGroup(self.id)

    def progress(self) -> float:
        """The share of the tasks of the job's present stages that are done, 0 to 1."""
        if self.status == "completed":
            return 1.0
        tracker, done, total = self.spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.id):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else []:
                s = tracker.getStageInfo(stage)
                if s:
                    done, total = done + s.numCompletedTasks, total + s.numTasks
        return done / total if total else 0.0

    def table(self) -> DataFrame:
        if self.status != "completed":
            raise RuntimeError(f"the job is {self.status}" + (f": {self.error}" if self.error else ""))
        return self.spark.read.parquet(self.path)

    def light(self) -> DataFrame:
        return results.light(self.table())

    def page(self, number: int = 1, size: int = 50, by: str = "score", descending: bool = True) -> DataFrame:
        """One page of the written results in the order of a column; nothing is scored again."""
        rows = self.light()
        return results.page(results.sort(rows, by, descending), number, size, self.table().count())

    def statistics(self) -> DataFrame:
        return results.statistics(self.table())

    def explain(self, row: int) -> DataFrame:
        return results.explain_row(self.table(), row)

    def export(self, path: str, format: str = "csv") -> str:
        return files.export(results.export_table(self.table(), *self.names).orderBy("Row"), path, format)
