"""Files that tasks write: temporary names, renamed when whole, in any file system pyarrow knows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def committed(uri: str) -> Iterator:
    """A stream to a file that gets its name only when it is complete.

    Two attempts of one task may write the same name: each has its own temporary file, and
    whichever is renamed last replaces equal bytes.
    """
    system, path = open_fs(uri)
    folder, name = path.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    temporary = f"{folder}/_tmp-{uuid.uuid4().hex}-{name}"
    try:
        with system.open_output_stream(temporary, compression=None) as out:
            yield out
    except BaseException:
        try:
            system.delete_file(temporary)
        except OSError:
            pass
        raise
    system.move(temporary, path)
