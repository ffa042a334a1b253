from __future__ import annotations

import os
import stat
import sys
import zipfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from classatlas.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture()
def jar():
    """Write an archive from ``(entry, text)`` pairs."""
    def write(path, *entries):
        os.makedirs(os.path.dirname(str(path)), exist_ok=True)
        with zipfile.ZipFile(str(path), "w", zipfile.ZIP_DEFLATED) as archive:
            for name, data in entries:
                archive.writestr(name, data)
        return str(path)

    return write


@pytest.fixture()
def fake_java(tmp_path):
    """A program standing for ``java``: prints its arguments to a log and a fixed text."""
    def make(output: str, code: int = 0, error: str = ""):
        folder = tmp_path / f"java{len(os.listdir(tmp_path))}"
        folder.mkdir()
        (folder / "output").write_text(output)
        script = folder / "java"
        script.write_text(
            f'#!/bin/sh\necho "$@" >> {folder}/calls\ncat {folder}/output\necho "{error}" >&2\nexit {code}\n'
        )
        script.chmod(script.stat().st_mode | stat.S_IXUSR)
        return str(script), str(folder / "calls")

    return make
