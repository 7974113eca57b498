"""A list of repositories, kept as YAML or JSON: register, remove, list, scan; and as a table."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .repository import sibling_repos


@dataclass
class Repo:
    name: str
    path: str
    tags: list[str] = field(default_factory=list)
    notes: str | None = None


class Registry:
    """Repositories by name; names are unique."""

    def __init__(self, file: str) -> None:
        self.file, self.repos = file, []
        if os.path.exists(file):
            with open(file, encoding="utf-8") as f:
                text = f.read()
            if file.endswith(".json"):
                found = json.loads(text or "{}")
            else:
                import yaml

                found = yaml.safe_load(text) or {}
            self.repos = [Repo(r["name"], r["path"], list(r.get("tags") or []), r.get("notes")) for r in found.get("repos") or []]

    def save(self) -> None:
        content = {"version": 1, "repos": [asdict(r) for r in self.repos]}
        if self.file.endswith(".json"):
            text = json.dumps(content, indent=2)
        else:
            import yaml

            text = yaml.safe_dump(content, sort_keys=False)
        with open(self.file, "w", encoding="utf-8") as f:
            f.write(text)

    def register(self, path: str, name: str | None = None, tags: tuple = (), notes: str | None = None) -> Repo:
        name = name or os.path.basename(os.path.abspath(path))
        if any(r.name == name for r in self.repos):
            raise ValueError(f"there is a repository named {name}")
        self.repos.append(repo := Repo(name, path, list(tags), notes))
        return repo

    def remove(self, name: str) -> None:
        if not any(r.name == name for r in self.repos):
            raise KeyError(name)
        self.repos = [r for r in self.repos if r.name != name]

    def scan(self, parent: str, register: bool = False) -> list[tuple[str, str]]:
        """Repositories below parent that are not in the list, and registers them if asked."""
        new = [(n, p) for n, p in sibling_repos(parent) if all(os.path.abspath(r.path) != os.path.abspath(p) for r in self.repos)]
        for name, path in new if register else ():
            self.register(path, name)
        return new

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, path, tags, notes, present)."""
        rows = [(r.name, r.path, r.tags, r.notes, os.path.isdir(r.path)) for r in self.repos]
        return spark.createDataFrame(rows, "name string, path string, tags array<string>, notes string, present boolean")
