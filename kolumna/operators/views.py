"""Named views: expressions over tables and other views, computed when they are asked for and again after a change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Views:
    """Tables by name, and views that depend on tables or views.

    A view is a plan, so nothing is computed before it is read. Setting a table (or view) forgets the plans of all views
    that depend on it, directly or not; they are made again when they are asked for.
    """

    def __init__(self) -> None:
        self._tables: dict[str, DataFrame] = {}
        self._views: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {}
        self._made: dict[str, DataFrame] = {}

    def set(self, name: str, df: DataFrame) -> None:
        self._views.pop(name, None)
        self._tables[name] = df
        self._forget(name)

    def view(self, name: str, f: Callable[..., DataFrame], *depends: str) -> None:
        """name :: f(depends...); a view may not depend on itself."""
        reach, seen = list(depends), set()
        while reach:
            d = reach.pop()
            if d == name:
                raise ValueError(f"view depends on itself: {name}")
            if d not in seen:
                seen.add(d)
                reach += self._views.get(d, (None, ()))[1]
        self._tables.pop(name, None)
        self._views[name] = (f, depends)
        self._forget(name)

    def _forget(self, name: str) -> None:
        self._made.pop(name, None)
        for v, (_, depends) in self._views.items():
            if name in depends and v != name:
                self._forget(v)

    def get(self, name: str) -> DataFrame:
        if name in self._tables:
            return self._tables[name]
        if name not in self._made:
            f, depends = self._views[name]
            self._made[name] = f(*[self.get(d) for d in depends])
        return self._made[name]

    def tables(self) -> list[str]:
        return sorted(self._tables)

    def views(self) -> list[str]:
        return sorted(self._views)
