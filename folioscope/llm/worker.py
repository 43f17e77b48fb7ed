"""Objects that are made once in a Python worker and used by all its tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """The object of this key.  Functions of this package travel by value, so
    their module's variables would not outlive a task; ``sys`` does."""
    store = sys.__dict__.setdefault("_folioscope_kept", {})
    if key not in store:
        store[key] = make()
    return store[key]
