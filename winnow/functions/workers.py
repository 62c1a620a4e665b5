"""What a Python worker keeps from task to task."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Hashable

from pyspark import cloudpickle


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """The object under ``key``, made at the first call in this process.

    Functions reach a worker anew with each task, so what they cache in their modules would not last.
    """
    store = sys.__dict__.setdefault("_winnow_kept", {})
    if key not in store:
        store[key] = make()
    return store[key]


class Shipped:
    """An object of any class on the executors: a broadcast of its pickled form, classes by value, as the package need
    not be there.  ``value`` is for one call in a task."""

    def __init__(self, spark, thing: object):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    @property
    def value(self) -> object:
        return pickle.loads(self.data.value)
