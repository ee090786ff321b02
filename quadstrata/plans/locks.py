"""Lock files with a time limit; what can't be read is no lock."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator

from .files import Store


def is_locked(store: Store, path: str, limit: float) -> bool:
    return store.exists(path) and _fresh(_content(store, path), limit)


def _content(store: Store, path: str) -> str:
    try:
        return store.read(path)
    except Exception:  # gone meanwhile
        return ""


def _fresh(content: str, limit: float) -> bool:
    try:
        return time.time() - float(json.loads(content)["time"]) < limit
    except (ValueError, KeyError, TypeError):
        return False


def take(store: Store, path: str, limit: float) -> str | None:
    """The content of the lock if it was taken: the file is created only where none is, in one step.

    A lock past its limit is moved aside first, and put back if it isn't the one that was read.
    """
    own = json.dumps({"time": time.time(), "owner": uuid.uuid4().hex})
    if store.create(path, own):
        return own
    old = _content(store, path)
    if _fresh(old, limit):
        return None
    aside = f"{path}.{uuid.uuid4().hex}"
    try:
        store.move(path, aside)
    except Exception:  # another process was first
        return None
    moved = _content(store, aside)
    if moved != old:
        store.create(path, moved)
        store.remove(aside)
        return None
    store.remove(aside)
    return own if store.create(path, own) else None


@contextlib.contextmanager
def lock(store: Store, path: str, limit: float) -> Iterator[bool]:
    """Whether the lock was taken; released at the end if so, unless another has taken it over since."""
    own = take(store, path, limit)
    try:
        yield own is not None
    finally:
        if own is not None and _content(store, path) == own:
            store.remove(path)
