"""Binary files by URI, opened inside tasks."""

from __future__ import annotations

import pyarrow.fs as pafs


def _located(uri: str):
    return pafs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = _located(uri)
    system.create_dir(path, recursive=True)


def open_output(uri: str):
    """A new file for writing; its folder is made if it isn't there."""
    make_folder(uri.rpartition("/")[0])
    system, path = _located(uri)
    return system.open_output_stream(path)


def open_random(uri: str):
    """A file for reading at any place."""
    system, path = _located(uri)
    return system.open_input_file(path)


def open_stream(uri: str):
    """A file for reading from its start."""
    system, path = _located(uri)
    return system.open_input_stream(path, buffer_size=1 << 20)
