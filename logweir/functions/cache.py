"""A bounded cache of open resources, such as file systems, in one process."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any


class OpenResources:
    """Keeps the resources used last; what is pushed out, removed or purged is closed.

    Data is cached by Spark; this is for handles that Python tasks open. Threads may share it.
    """

    def __init__(self, size: int, opened: Callable[[Hashable], Any], closed: Callable[[Hashable, Any], None] = lambda k, v: None):
        if size < 1:
            raise ValueError("a cache holds one resource or more")
        self.size, self.opened, self.closed = size, opened, closed
        self.held: OrderedDict[Hashable, Any] = OrderedDict()
        self.lock = threading.RLock()

    def get(self, key: Hashable) -> Any:
        """The resource, opened if it is not held; an error while opening leaves the cache as it was."""
        with self.lock:
            if key in self.held:
                self.held.move_to_end(key)
                return self.held[key]
            value = self.held[key] = self.opened(key)
            while len(self.held) > self.size:
                self.closed(*self.held.popitem(last=False))
            return value

    def __contains__(self, key: Hashable) -> bool:
        return key in self.held

    def __len__(self) -> int:
        return len(self.held)

    def remove(self, key: Hashable) -> bool:
        with self.lock:
            if key not in self.held:
                return False
            self.closed(key, self.held.pop(key))
            return True

    def purge(self) -> None:
        with self.lock:
            while self.held:
                self.closed(*self.held.popitem(last=False))
