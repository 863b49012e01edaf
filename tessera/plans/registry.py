"""Registered queries: id, needed tables, levels; and a phase timer."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Query:
    id: str
    needs: tuple[str, ...]
    run: Callable[[dict[str, DataFrame]], DataFrame]
    requires_config: bool = False
    meta: bool = False


REGISTRY: dict[str, Query] = {}


def query(id: str, *needs: str, requires_config: bool = False, meta: bool = False):
    """Register a function of named tables as a query."""

    def add(f):
        REGISTRY[id] = Query(id, needs, f, requires_config, meta)
        return f

    return add


def enabled(levels: dict[str, str], configured: set[str]) -> list[Query]:
    """Queries that are not `allow` and, if they need a table of settings, have one."""
    return [q for q in REGISTRY.values() if levels.get(q.id, "warn") != "allow" and (not q.requires_config or q.id in configured)]


def needed_tables(queries: list[Query]) -> set[str]:
    return {t for q in queries for t in q.needs}


def for_crate(overrides: dict, crate: str, default):
    """A crate's settings replace the defaults as a whole."""
    return overrides.get(crate, default)


@contextmanager
def phase(name: str, log: list | None = None):
    began = time.perf_counter()
    yield
    if log is not None:
        log.append((name, time.perf_counter() - began))
