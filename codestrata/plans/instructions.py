"""Files of instructions for coding tools, made of a project's facts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from .report import markdown

#: The files that tools read.
TOOLS = {
    "codex": ("AGENTS.md",),
    "cursor": (".cursorrules", ".cursor/rules/project-context.mdc"),
    "copilot": (".github/copilot-instructions.md",),
    "cline": (".clinerules",),
    "generic": ("CONVENTIONS.md",),
}
NOTE = "<!-- Generated. Do not edit; run again to update. -->"


def instructions(project: str, facts: dict[str, DataFrame], most: int = 20) -> str:
    """One document: the project's name and a table of each kind of facts, by heading."""
    parts = [f"# {project}", NOTE]
    for heading, table in facts.items():
        parts += [f"## {heading}", markdown(table, most)]
    return "\n\n".join(parts) + "\n"


def write(tool: str, project: str, facts: dict[str, DataFrame], folder: str) -> list[str]:
    """Write the files that a tool reads below folder; their paths."""
    text, done = instructions(project, facts), []
    for name in TOOLS[tool]:
        place = os.path.join(folder, name)
        os.makedirs(os.path.dirname(place), exist_ok=True)
        # rules of this kind begin with front matter
        head = f"---\ndescription: {project}\nalwaysApply: true\n---\n\n" if name.endswith(".mdc") else ""
        with open(place, "w", encoding="utf-8") as f:
            f.write(head + text)
        done.append(place)
    return done
