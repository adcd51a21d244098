"""What a runner keeps on its own machine: scratch values, temporary folders, the log of submissions, log lines."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import re
import shutil
import tempfile
import time


class Scratch:
    """Small values of a node, by key, that outlive its attempts: what an attempt put, the next one gets. They go when the
    node succeeds, if it asked for that, and a resumed run can take over those of the run before."""

    def __init__(self, base: str, run_id: str, node: str):
        self.base, self.run_id, self.node = base, run_id, node
        self.path = f"{base}/{run_id}/{self._name(node)}"

    @staticmethod
    def _name(key: str) -> str:
        return hashlib.sha256(key.encode()).hexdigest()

    def put(self, key: str, value: bytes) -> None:
        os.makedirs(self.path, exist_ok=True)
        at = f"{self.path}/{self._name(key)}"
        with open(f"{at}.new", "wb") as f:
            f.write(json.dumps(key).encode() + b"\n" + value)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{at}.new", at)

    def get(self, key: str) -> bytes | None:
        try:
            with open(f"{self.path}/{self._name(key)}", "rb") as f:
                return f.read().split(b"\n", 1)[1]
        except FileNotFoundError:
            return None

    def remove(self, key: str) -> None:
        if os.path.exists(at := f"{self.path}/{self._name(key)}"):
            os.remove(at)

    def keys(self) -> list[str]:
        names = [n for n in os.listdir(self.path) if len(n) == 64] if os.path.isdir(self.path) else []
        out = []
        for n in names:
            with open(f"{self.path}/{n}", "rb") as f:
                out.append(json.loads(f.readline()))
        return sorted(out)

    def keep_until_success(self) -> None:
        os.makedirs(self.path, exist_ok=True)
        open(f"{self.path}/transient", "w").close()

    def remove_on_success(self) -> None:
        """Called when the node has succeeded."""
        if os.path.exists(f"{self.path}/transient"):
            shutil.rmtree(self.path)

    def carry_forward(self, from_run: str) -> list[str]:
        """Takes over the values of the same node in another run, but for keys that are here already."""
        before = Scratch(self.base, from_run, self.node)
        taken = [k for k in before.keys() if self.get(k) is None]
        for k in taken:
            self.put(k, before.get(k))
        return taken


class RunFolder(str):
    """The path of a run's temporary folder."""

    def cleanup(self) -> None:
        shutil.rmtree(self, ignore_errors=True)


def run_folder(base: str, run_id: str) -> RunFolder:
    """A temporary folder for a run, marked with the process that uses it."""
    os.makedirs(f"{base}/tmp", exist_ok=True)
    path = RunFolder(tempfile.mkdtemp(prefix=f"{re.sub('[^A-Za-z0-9-]', '_', run_id)}.", dir=f"{base}/tmp"))
    with open(f"{path}/owner", "w") as f:
        f.write(str(os.getpid()))
    return path


def sweep(base: str, older_than: float = 0.0) -> list[str]:
    """Removes temporary folders that runs left behind: those whose process is gone, untouched for so many seconds."""
    gone = []
    for name in sorted(os.listdir(f"{base}/tmp")) if os.path.isdir(f"{base}/tmp") else []:
        path = f"{base}/tmp/{name}"
        try:
            with open(f"{path}/owner") as f:
                os.kill(int(f.read()), 0)
        except (FileNotFoundError, ProcessLookupError, ValueError):
            if time.time() - os.path.getmtime(path) >= older_than:
                shutil.rmtree(path)
                gone.append(path)
        except PermissionError:  # there, and someone else's
            pass
    return gone


class SubmissionLog:
    """What was about to be launched, written and synced before it is. After a crash it tells what may be running."""

    def __init__(self, path: str):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        self.path = path

    def append(self, run_id: str, node: str, attempt: int, executor: str, **more: object) -> dict:
        row = {"run_id": run_id, "node": node, "attempt": attempt, "executor": executor, **more}
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(row, sort_keys=True, separators=(",", ":")) + "\n")
            f.flush()
            os.fsync(f.fileno())
        return row

    def read(self) -> list[dict]:
        """All rows; a last line that a crash cut off was never launched."""
        out = []
        if os.path.exists(self.path):
            with open(self.path, encoding="utf-8") as f:
                lines = f.read().split("\n")
            for i, line in enumerate(lines):
                try:
                    out += [json.loads(line)] if line else []
                except ValueError:
                    if i < len(lines) - 1:
                        raise
        return out

    def stranded(self, done: set[tuple[str, str, int]]) -> list[dict]:
        """Submitted attempts of which no outcome is known."""
        return [r for r in self.read() if (r["run_id"], r["node"], r["attempt"]) not in done]


class JsonLines(logging.Formatter):
    """Log records as one JSON object a line, with the run, the node and the attempt where they are known."""

    def format(self, record: logging.LogRecord) -> str:
        own = {k: getattr(record, k) for k in ("run_id", "node", "attempt") if hasattr(record, k)}
        row = {"at": self.formatTime(record), "level": record.levelname.lower(), "message": record.getMessage(), **own}
        if record.exc_info:
            row["error"] = self.formatException(record.exc_info)
        return json.dumps(row, sort_keys=True)


class Plain(logging.Formatter):
    """The same for people."""

    def format(self, record: logging.LogRecord) -> str:
        where = "/".join(str(getattr(record, k)) for k in ("run_id", "node", "attempt") if hasattr(record, k))
        return f"{self.formatTime(record)} {record.levelname} {where + ': ' if where else ''}{record.getMessage()}"


def log_to(stream, structured: bool = True, level: int = logging.INFO) -> logging.Handler:
    """Sends the runner's log lines to a stream."""
    handler = logging.StreamHandler(stream)
    handler.setFormatter(JsonLines() if structured else Plain())
    own = logging.getLogger("runfold")
    own.addHandler(handler)
    own.setLevel(level)
    return handler


def span_logger(run_id: str, node: str, attempt: int) -> logging.LoggerAdapter:
    return logging.LoggerAdapter(logging.getLogger("runfold"), {"run_id": run_id, "node": node, "attempt": attempt})
