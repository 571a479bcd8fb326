"""What is built once a worker process: models of recognition, clients of language models.

Spark keeps Python workers for many tasks, and a task's batches go to one of them. A factory is known by its name; what it makes is
kept in this module, in the worker, so that it is made once however many batches and tasks the worker sees."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from typing import Any, NamedTuple

LOG = logging.getLogger(__name__)
_made: dict[str, Any] = {}
_lock = threading.Lock()


class Factory(NamedTuple):
    """How something is made: a name for it, and functions that are tried in turn, such as one for each device. The first that doesn't
    raise is taken; if all raise, the last one's exception is."""

    name: str
    ways: tuple[Callable[[], Any], ...]


def made(factory: Factory) -> Any:
    """The factory's thing, made when it is first asked for in this process."""
    with _lock:
        if factory.name not in _made:
            for i, way in enumerate(factory.ways):
                try:
                    _made[factory.name] = way()
                    break
                except Exception as e:  # the ways are the caller's code
                    if i == len(factory.ways) - 1:
                        raise
                    LOG.warning("%s: %s; the next way is tried", factory.name, e)
        return _made[factory.name]
