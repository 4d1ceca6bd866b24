"""A registry of named tasks: functions from a DataFrame to a DataFrame, found by name and run side by side."""

from __future__ import annotations

import importlib
import logging
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Task = Callable[[DataFrame], DataFrame]
_log = logging.getLogger(__name__)


@dataclass
class TaskRegistry:
    tasks: dict[str, tuple[str, Task]] = field(default_factory=dict)

    def register(self, name: str, description: str = "", replace: bool = False) -> Callable[[Task], Task]:
        """As a decorator: the task's name in any case. A second one of a name is an error, or with `replace` a warning."""

        def add(task: Task) -> Task:
            key = name.lower()
            if key in self.tasks:
                if not replace:
                    raise ValueError(f"task {name} is registered already")
                _log.warning("task %s is registered again; the last one counts", name)
            self.tasks[key] = (description, task)
            return task

        return add

    def load(self, package: str) -> list[str]:
        """Import all modules of a package, whose decorators then register what they define; returns the names of the modules."""
        found = importlib.import_module(package)
        names = sorted(m.name for m in pkgutil.iter_modules(found.__path__))
        for n in names:
            importlib.import_module(f"{package}.{n}")
        return names

    def names(self) -> list[str]:
        return sorted(self.tasks)

    def run(self, name: str, df: DataFrame) -> DataFrame:
        if name.lower() not in self.tasks:
            raise KeyError(f"no task {name}; there are {self.names()}")
        return self.tasks[name.lower()][1](df)

    def run_all(self, df: DataFrame) -> DataFrame:
        """The rows of all tasks, which must have the same columns, with `task`; one plan, so Spark shares what they read."""
        out = None
        for n in self.names():
            part = self.run(n, df).select(F.lit(n).alias("task"), "*")
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no task is registered")
        return out
