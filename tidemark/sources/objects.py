"""Content-addressed objects: gzip under the SHA-256 of the plain bytes, in folders of two letters."""

from __future__ import annotations

import gzip
import hashlib
import os
import re
import time
import uuid

_ADDRESS = re.compile(r"[0-9a-f]{64}")


class ObjectStore:
    def __init__(self, root: str) -> None:
        self.root = root

    def _path(self, address: str) -> str:
        if not _ADDRESS.fullmatch(address):
            raise ValueError("not an address")
        return f"{self.root}/{address[:2]}/{address}.gz"

    def put(self, data: bytes) -> str:
        address = hashlib.sha256(data).hexdigest()
        path = self._path(address)
        if not os.path.exists(path):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            staged = f"{path}.{uuid.uuid4().hex}"
            with open(staged, "wb") as f:
                f.write(gzip.compress(data, 9, mtime=0))
            os.replace(staged, path)
        return address

    def get(self, address: str) -> bytes:
        with open(self._path(address), "rb") as f:
            data = gzip.decompress(f.read())
        if hashlib.sha256(data).hexdigest() != address:
            raise ValueError("a damaged object")
        return data

    def has(self, address: str) -> bool:
        return os.path.exists(self._path(address))

    def delete(self, address: str) -> bool:
        if not self.has(address):
            return False
        os.remove(self._path(address))
        return True

    def list(self) -> list[tuple[str, float]]:
        """(address, seconds since written), sorted."""
        out = []
        for folder, _, names in os.walk(self.root):
            out += [(n[:64], time.time() - os.stat(f"{folder}/{n}").st_mtime) for n in names if re.fullmatch(r"[0-9a-f]{64}\.gz", n)]
        return sorted(out)

    def collect_orphans(self, referenced: set[str], least_age: float = 3600, most: int = 1000, dry_run: bool = False) -> list[str]:
        gone = [a for a, age in self.list() if a not in referenced and age >= least_age][:most]
        if not dry_run:
            for a in gone:
                self.delete(a)
        return gone
