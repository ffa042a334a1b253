"""External decompiler as an operator over rows.

The tool is any command line program run once per row inside a task. Its output
is a side effect of an external process, so results are checkpointed: later
actions and retries of later stages do not run the tool again.

The output of a whole archive is cut at the banners while it comes from the pipe, one row
per piece, so that a task holds one class of it and not the archive.
"""

from __future__ import annotations

import codecs
import subprocess
import threading
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from classatlas.functions.text import DECOMPILED_BANNER
from classatlas.schemas import DECOMPILER_OUTPUT
from classatlas.session import ensure_checkpoint_dir

# Command line of the tool
_QUIET = ("--silent", "true", "--comments", "false")

_CHUNK, _BYTES = 1 << 16, 16 << 20
_PIECES = "jar_path string, entry_idx long, piece string, error string"


class ToolFailed(RuntimeError):
    """The tool could not be run, failed, or took too long."""


def split_at_banners(chunks: Iterable[bytes]) -> Iterator[str]:
    """Pieces of tool output, each from a banner to the next one, with Unix line ends.

    What comes before the first banner is dropped; output without any is one piece.
    """
    decoder, banner = codecs.getincrementaldecoder("utf-8")("replace"), DECOMPILED_BANNER
    held, searched, found = "", 0, False
    carry = ""  # a line end may be cut in two
    for chunk in _with_end(chunks):
        text = carry + (decoder.decode(b"", True) if chunk is None else decoder.decode(chunk))
        carry = "\r" if text.endswith("\r") and chunk is not None else ""
        held += (text[:-1] if carry else text).replace("\r\n", "\n")
        while (at := held.find(banner, searched)) >= 0:
            if found:
                yield held[:at]
            held, searched, found = held[at:], len(banner), True
        searched = max(searched, len(held) - len(banner) + 1) if not found else max(len(banner), len(held) - len(banner) + 1)
    if held or not found:
        yield held


def _with_end(chunks: Iterable[bytes]) -> Iterator[bytes | None]:
    yield from chunks
    yield None


@dataclass(frozen=True)
class Decompiler:
    """Java decompiler jar and the ``java`` program that runs it.

    ``max_parallel`` limits child processes over the whole cluster; by default
    every task slot may run one. A child that takes longer than ``timeout`` seconds
    is ended and counts as failed.
    """

    tool: str
    java: str = "java"
    max_parallel: int | None = None
    timeout: float = 1800

    def class_command(self, jar_path: str, fqn: str) -> list[str]:
        return [self.java, "-jar", self.tool, "--extraclasspath", jar_path, fqn, *_QUIET]

    def jar_command(self, jar_path: str) -> list[str]:
        return [self.java, "-jar", self.tool, jar_path, *_QUIET]

    def run(self, jar_path: str, fqn: str | None) -> tuple[str | None, str | None]:
        command = self.jar_command(jar_path) if fqn is None else self.class_command(jar_path, fqn)
        try:
            done = subprocess.run(command, capture_output=True, check=False, timeout=self.timeout)
        except subprocess.TimeoutExpired:
            return None, f"Decompilation failed: no end after {self.timeout:g} seconds"
        except OSError as failure:
            return None, f"Failed to execute java: {failure}"
        if done.returncode != 0:
            return None, "Decompilation failed: " + done.stderr.decode("utf-8", "replace").strip()
        return done.stdout.decode("utf-8", "replace"), None

    def pieces(self, jar_path: str) -> Iterator[str]:
        """The output for a whole archive in pieces as it comes; raises ``ToolFailed``, also after some pieces."""
        try:
            child = subprocess.Popen(self.jar_command(jar_path), stdout=subprocess.PIPE, stderr=subprocess.PIPE)
        except OSError as failure:
            raise ToolFailed(f"Failed to execute java: {failure}") from failure
        late = threading.Event()

        def end() -> None:
            late.set()
            child.kill()

        # the end of what the tool complains of; it must be read, or the tool waits
        complaints: deque[bytes] = deque(maxlen=64)
        reader = threading.Thread(target=lambda: complaints.extend(iter(lambda: child.stderr.read(1024), b"")), daemon=True)
        watch = threading.Timer(self.timeout, end)
        reader.start()
        watch.start()
        try:
            yield from split_at_banners(iter(lambda: child.stdout.read1(_CHUNK), b""))
            child.wait()
        finally:
            watch.cancel()
            child.kill()
            child.wait()
            reader.join()
            child.stdout.close()
            child.stderr.close()
        if late.is_set():
            raise ToolFailed(f"Decompilation failed: no end after {self.timeout:g} seconds")
        if child.returncode != 0:
            raise ToolFailed("Decompilation failed: " + b"".join(complaints).decode("utf-8", "replace").strip())


def decompile_archives(targets: DataFrame, tool: Decompiler) -> DataFrame:
    """``(jar_path, entry_idx, piece, error)``: one row per piece of the output for each ``jar_path``.

    An archive for which the tool failed has one row with an error, perhaps after some pieces.
    """
    def run_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for jar_path in batch["jar_path"]:
                number = 0
                try:
                    for piece in tool.pieces(jar_path):
                        rows.append((jar_path, number, piece, None))
                        number, size = number + 1, size + len(piece)
                        if size >= _BYTES:
                            yield pd.DataFrame(rows, columns=["jar_path", "entry_idx", "piece", "error"])
                            rows, size = [], 0
                except ToolFailed as failure:
                    rows.append((jar_path, number, None, str(failure)))
        if rows:
            yield pd.DataFrame(rows, columns=["jar_path", "entry_idx", "piece", "error"])

    ensure_checkpoint_dir(targets.sparkSession)
    tasks = tool.max_parallel or targets.sparkSession.sparkContext.defaultParallelism * 4
    return targets.select("jar_path").repartition(tasks).mapInPandas(run_all, _PIECES).checkpoint()


def decompile(requests: DataFrame, tool: Decompiler) -> DataFrame:
    """Run the tool for each ``(jar_path, fqn)``; a NULL ``fqn`` asks for the whole archive.

    A task runs one child process at a time.
    """
    def run_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for jar_path, fqn in zip(batch["jar_path"], batch["fqn"]):
                name = fqn if isinstance(fqn, str) else None
                output, error = tool.run(jar_path, name)
                yield pd.DataFrame(
                    [(jar_path, name, output, error)],
                    columns=["jar_path", "fqn", "output", "error"],
                )

    ensure_checkpoint_dir(requests.sparkSession)
    tasks = tool.max_parallel or requests.sparkSession.sparkContext.defaultParallelism * 4
    spread = requests.select("jar_path", "fqn").repartition(tasks)
    return spread.mapInPandas(run_all, DECOMPILER_OUTPUT).checkpoint()
