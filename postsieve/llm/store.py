"""Files in the shared folder, from executors: any store that Arrow can open by its URI. A name with a scheme that is
not a whole URI is refused, since taken as a path it would be a folder of each executor's own."""

from __future__ import annotations

import os
import re

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri):
            raise ValueError(f"not a folder that driver and executors share: {uri}")
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def make_folder(uri: str) -> None:
    store, path = opened(uri)
    store.create_dir(path, recursive=True)


def write_whole(uri: str, name: str, attempt: int, parts: list[bytes]) -> None:
    """A file under its final name only when it is complete: a repeated or doubled task leaves one file."""
    store, path = opened(uri)
    draft = f"{path}/.{name}.{attempt}"
    with store.open_output_stream(draft, compression=None) as out:
        for part in parts:
            out.write(part)
    store.move(draft, f"{path}/{name}")
