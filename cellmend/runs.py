"""The stages of a run, kept in the shared folder: what is done, and that it still belongs to what the run was started with."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from cellmend.sources.reports import redacted


def utc_now() -> str:
    """The time in UTC, as ISO 8601 writes it."""
    return datetime.now(timezone.utc).isoformat(timespec="seconds").replace("+00:00", "Z")


def fingerprint(config: object) -> str:
    """The digest of a configuration, whatever the order of its names."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


class BindingDrift(RuntimeError):
    """A run that is taken up with another configuration than it was started with."""


class Run:
    """One run: its binding and the state of its stages, a small JSON file through the session's file system.

    Stages go from `running` to `complete` or `failed`; one that is complete is not run again. Secret values of
    the configuration count in the fingerprint, but are never written.
    """

    def __init__(self, spark: SparkSession, folder: str, config: dict):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/run.json"
        state = self._read()
        own = fingerprint(config)
        if state is None:
            state = {"fingerprint": own, "config": redacted(config), "created_at": utc_now(), "stages": {}}
            self._write(state)
        elif state["fingerprint"] != own:
            raise BindingDrift("the run was started with another configuration")
        self.state = state

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _read(self) -> dict | None:
        files, path = self._file(self.path)
        if not files.exists(path):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(self.path).collect()))  # one small file

    def _write(self, state: dict) -> None:
        files, new = self._file(f"{self.path}.new")
        out = files.create(new, True)
        out.write(bytearray(json.dumps(state, sort_keys=True, ensure_ascii=False).encode()))
        out.close()
        path = self._file(self.path)[1]
        files.delete(path, False)
        if not files.rename(new, path):
            raise OSError(f"{self.path} can't be written")

    def completed(self, stage: str) -> bool:
        return self.state["stages"].get(stage, {}).get("status") == "complete"

    def stage(self, name: str, work, after: tuple[str, ...] = ()) -> dict:
        """Runs work (a function that gives a small dict) unless the stage is complete; the stages it comes after must be."""
        lacking = [s for s in after if not self.completed(s)]
        if lacking:
            raise RuntimeError(f"{name} comes after {', '.join(lacking)}")
        if not self.completed(name):
            self._set(name, status="running", started_at=utc_now())
            try:
                result = work() or {}
            except Exception as e:
                self._set(name, status="failed", error=type(e).__name__)
                raise
            self._set(name, status="complete", finished_at=utc_now(), result=redacted(result))
        return self.state["stages"][name]["result"]

    def _set(self, name: str, **values: object) -> None:
        self.state["stages"][name] = self.state["stages"].get(name, {}) | values
        self._write(self.state)
