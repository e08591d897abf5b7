"""Settings and named providers of documents."""

from __future__ import annotations

import getpass
import socket
from collections.abc import Callable
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Settings:
    """What a linking run needs; numbers as published for the original collections."""

    mu: float = 2000.0
    candidates: int = 100
    context_candidates: int = 250
    feedback_documents: int = 10
    feedback_terms: int = 5
    nil_threshold: float = -10.0
    kb_path: str = ""
    source_path: str = ""

    @staticmethod
    def read(folder: str, user: str | None = None, host: str | None = None) -> Settings:
        """From property files (``name = value``, ``#`` comments): the first found of <user>@<host>, <user>, <host> and default, over the defaults."""
        user, host = user or getpass.getuser(), host or socket.gethostname()
        found: dict[str, str] = {}
        for name in (f"{user}@{host}", user, host, "default"):
            path = Path(folder, f"{name}.properties")
            if path.exists():
                lines = (x.split("#")[0] for x in path.read_text().splitlines())
                found = {k.strip(): v.strip() for k, v in (x.split("=", 1) for x in lines if "=" in x)}
                break
        known = {f.name: type(f.default) for f in fields(Settings)}
        if unknown := set(found) - set(known):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return Settings(**{k: known[k](v) for k, v in found.items()})

    def apply(self, spark: SparkSession) -> None:
        """Puts the settings in the session, as larkspan.<name>."""
        for f in fields(self):
            spark.conf.set(f"larkspan.{f.name}", str(getattr(self, f.name)))


class Providers:
    """Collections by name, opened when first asked for; ``default`` stands for names that aren't known."""

    def __init__(self, **openers: Callable[[], DataFrame]) -> None:
        self._openers, self._open = openers, {}

    def register(self, name: str, opener: Callable[[], DataFrame]) -> None:
        self._openers[name] = opener
        self._open.pop(name, None)

    def __getitem__(self, name: str) -> DataFrame:
        at = name if name in self._openers else "default"
        if at not in self._openers:
            raise KeyError(name)
        if at not in self._open:
            self._open[at] = self._openers[at]()
        return self._open[at]

    def views(self) -> None:
        """Every collection as a temporary view of its name."""
        for name in self._openers:
            self[name].createOrReplaceTempView(name)
