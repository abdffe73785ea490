"""Files that tasks write to and read from the shared folder, in any store that pyarrow reaches by URI."""

from __future__ import annotations

import re
import uuid


def open_store(uri: str):
    """The file system of a URI and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_whole(folder: str, stem: str, write) -> str:
    """Lets ``write`` fill a stream and returns the finished file's URI.

    The name is this attempt's own, and the file takes it only when it is whole: what an attempt
    that was lost or repeated leaves behind is never read, as the table of names that its task
    returns isn't committed."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{path}/.{name}") as out:
        write(out)
    store.move(f"{path}/.{name}", f"{path}/{name}")
    return f"{folder.rstrip('/')}/{name}"
