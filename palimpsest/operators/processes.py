"""Models that live in processes of their own, and in workers of their own."""

from __future__ import annotations

import atexit
import json
import select
import subprocess
from collections.abc import Callable

from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import SparkSession


class LineServer:
    """A child process that answers JSON lines.

    It says ``{"status": "ready"}`` first; then each request, ``{"text": ...}`` with what else the requests hold, is a line, and so is each answer,
    ``{"corrected": ...}`` or ``{"error": ...}``. A process that dies or is silent for ``patience`` seconds is started again once for the
    request at hand; if that fails too the request fails.
    """

    def __init__(self, command: list[str], patience: float = 300.0, **more: str):
        self.command, self.patience, self.more, self.process, self.starts = command, patience, more, None, 0

    def _line(self) -> dict:
        out = self.process.stdout
        if not select.select([out], [], [], self.patience)[0]:
            raise TimeoutError(f"{self.command[0]} is silent")
        line = out.readline()
        if not line:
            raise EOFError(f"{self.command[0]} has ended")
        return json.loads(line)

    def start(self) -> None:
        self.stop()
        self.process, self.starts = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, bufsize=0), self.starts + 1
        said = self._line()
        if said.get("status") != "ready":
            self.stop()
            raise RuntimeError(f"{self.command[0]} is not ready: {said}")

    def stop(self) -> None:
        if self.process:
            self.process.kill()
            self.process.wait()
            self.process.stdin.close()
            self.process.stdout.close()
        self.process = None

    def _ask(self, text: str) -> dict:
        self.process.stdin.write(json.dumps({"text": text, **self.more}, ensure_ascii=False).encode() + b"\n")
        return self._line()

    def __call__(self, text: str) -> str:
        if self.process is None:
            self.start()
        try:
            answer = self._ask(text)
        except (OSError, EOFError, TimeoutError, ValueError):
            self.start()
            try:
                answer = self._ask(text)
            except (OSError, EOFError, TimeoutError, ValueError):
                self.stop()  # the next request starts afresh
                raise
        if "error" in answer:
            raise RuntimeError(answer["error"])
        return answer.get("corrected", text)


_servers: dict[str, LineServer] = {}


def process_model(command: list[str], patience: float = 300.0, **more: str) -> Callable[[str], str]:
    """A corrector (see :func:`.recognition.correct`) that is a child process, one for each Python worker, started at its first line.

    A line that fails stays as it was, as with any corrector. Further arguments go with each request.
    """
    key = json.dumps([command, patience, more], sort_keys=True)

    def ask(text: str) -> str:
        if key not in _servers:
            _servers[key] = LineServer(command, patience, **more)
            atexit.register(_servers[key].stop)
        return _servers[key](text)

    return ask


def residency(spark: SparkSession, cores: int = 4, memory: str = "8g", gpus: int = 0) -> ResourceProfile | None:
    """What a model's stage asks of its executors: they run that model's tasks alone, one at a time, so no two models share one.

    Stages of different profiles never share an executor, and a profile's executors go when its stage is over (dynamic allocation). Under a local
    master there are no executors to choose from, so there is no profile: nothing.
    """
    if spark.sparkContext.master.startswith("local"):
        return None
    wanted, task = ExecutorResourceRequests().cores(cores).memory(memory).pysparkMemory(memory), TaskResourceRequests().cpus(cores)
    if gpus:
        wanted, task = wanted.resource("gpu", gpus), task.resource("gpu", gpus)
    return ResourceProfileBuilder().require(wanted).require(task).build
