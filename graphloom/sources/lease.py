"""Single-writer lease and status files of one host: a JSON file replaced atomically."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable


def write_status(path: str, body: dict) -> None:
    """Write JSON beside the target and rename it over, so readers see the old or the new file."""
    temp = f"{path}.{uuid.uuid4().hex}"
    with open(temp, "w") as f:
        json.dump(body, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


class Lease:
    """Owner of a store for ``ttl`` seconds after its last heartbeat; others attach until it lapses."""

    def __init__(self, path: str, ttl: float = 30.0, clock: Callable[[], float] = time.time):
        self.path, self.ttl, self.clock, self.nonce = path, ttl, clock, uuid.uuid4().hex

    def read(self) -> dict | None:
        try:
            with open(self.path) as f:
                return json.load(f)
        except (FileNotFoundError, ValueError):
            return None

    def acquire(self) -> bool:
        """Become the owner (true) or attach (false). The first claim of a free path is exclusive by file creation."""
        try:
            os.close(os.open(f"{self.path}.claim", os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            held = self.read()
            if held and held["nonce"] != self.nonce and self.clock() - held["beat"] < self.ttl:
                return False
        self.heartbeat()
        held = self.read()
        return held is not None and held["nonce"] == self.nonce

    def heartbeat(self) -> None:
        write_status(self.path, {"nonce": self.nonce, "beat": self.clock(), "pid": os.getpid()})

    def release(self) -> None:
        held = self.read()
        if held and held["nonce"] == self.nonce:
            for p in (self.path, f"{self.path}.claim"):
                if os.path.exists(p):
                    os.unlink(p)
