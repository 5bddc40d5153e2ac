"""Whole files in the shared folder, written under temporary names and renamed when complete."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

from pyarrow import fs

#: Bytes read at once.
CHUNK = 1 << 18


class NewFile:
    """A file that is written piece by piece under a name of its own and renamed by ``commit``: readers never see part of it, and a second attempt of a task replaces it by equal bytes."""

    def __init__(self, folder: str, name: str):
        self.store, path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(path, recursive=True)
        self.held, self.path, self.uri = f"{path}/_temporary-{name}-{uuid.uuid4().hex}", f"{path}/{name}", f"{folder}/{name}"
        self.out, self.digest, self.size = self.store.open_output_stream(self.held, compression=None), hashlib.sha256(), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)

    def commit(self) -> tuple[str, str]:
        """(path, SHA-256)."""
        self.out.close()
        self.store.move(self.held, self.path)
        return self.uri, self.digest.hexdigest()


def write_file(folder: str, name: str, data: bytes) -> tuple[str, str]:
    """Write ``data`` as one file. Returns (path, SHA-256)."""
    new = NewFile(folder, name)
    new.write(data)
    return new.commit()


def read_chunks(uri: str, sha256: str | None = None) -> Iterator[bytes]:
    """The file's bytes, a chunk at a time; after the last one the digest is compared."""
    store, path = fs.FileSystem.from_uri(uri)
    digest = hashlib.sha256()
    with store.open_input_stream(path, compression=None) as f:
        while data := f.read(CHUNK):
            digest.update(data)
            yield data
    if sha256 and digest.hexdigest() != sha256:
        raise ValueError(f"{uri} is not what its manifest says")


def read_file(uri: str, sha256: str | None = None) -> bytes:
    return b"".join(read_chunks(uri, sha256))
