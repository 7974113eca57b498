"""The folder of numbered sections beside a project: snapshots of it, the way back, and the phase that work is in."""

from __future__ import annotations

import os
import shutil
import time

#: The phases, and which may follow which.
PHASES = ("uninitialized", "discovered", "planning", "awaiting_approval", "executing", "paused", "done")
NEXT = {
    "uninitialized": ("discovered",), "discovered": ("planning",), "planning": ("awaiting_approval",),
    "awaiting_approval": ("executing", "planning"), "executing": ("done", "paused"), "paused": ("executing", "planning", "awaiting_approval"),
    "done": ("planning", "discovered"),
}
#: Where a layer keeps its snapshots; they are no part of one themselves.
KEPT = os.path.join("cache", "snapshots")


def advance(phase: str, to: str) -> str:
    """to, if it may follow phase."""
    if to not in NEXT[phase]:
        raise ValueError(f"{to} doesn't follow {phase}")
    return to


def snapshots(layer: str) -> list[str]:
    """The names of a layer's snapshots, the latest first."""
    place = os.path.join(layer, KEPT)
    return sorted(os.listdir(place), reverse=True) if os.path.isdir(place) else []


def _copy(layer: str, to: str) -> None:
    shutil.copytree(layer, to, ignore=lambda folder, names: ["snapshots"] if os.path.basename(folder) == "cache" else [])


def snapshot(layer: str, about: str, at: float | None = None) -> str:
    """Copy a layer; the name of the copy begins with the time."""
    name = f"{time.strftime('%Y-%m-%dT%H-%M-%S', time.gmtime(at))}-{about}"
    _copy(layer, os.path.join(layer, KEPT, name))
    return name


def changes(layer: str, name: str | None = None) -> dict[str, str]:
    """What a rollback to a snapshot, the latest if not named, would do: path to restore, remove or revert."""
    old, new = _files(os.path.join(layer, KEPT, _wanted(layer, name))), _files(layer)
    verbs = {p: "restore" if p not in new else "remove" if p not in old else "revert" for p in old.keys() | new.keys()}
    return {p: v for p, v in sorted(verbs.items()) if v != "revert" or old[p] != new[p]}


def rollback(layer: str, name: str | None = None, at: float | None = None) -> str:
    """Set a layer back to a snapshot, the latest if not named; the state before is kept as a snapshot, too."""
    name = _wanted(layer, name)
    snapshot(layer, "before-rollback", at)
    old = os.path.join(layer, KEPT, name)
    for path, verb in changes(layer, name).items():
        place = os.path.join(layer, path)
        if verb == "remove":
            os.remove(place)
        else:
            os.makedirs(os.path.dirname(place), exist_ok=True)
            shutil.copy2(os.path.join(old, path), place)
    return name


def _wanted(layer: str, name: str | None) -> str:
    known = snapshots(layer)
    if not known or name is not None and name not in known:
        raise FileNotFoundError(f"no snapshot {name or ''} of {layer}")
    return name or known[0]


def _files(root: str) -> dict[str, bytes]:
    """Contents by path below root, without snapshots."""
    out = {}
    for folder, below, names in os.walk(root):
        if os.path.relpath(folder, root) == "cache":
            below[:] = [b for b in below if b != "snapshots"]
        for n in names:
            place = os.path.join(folder, n)
            with open(place, "rb") as f:
                out[os.path.relpath(place, root)] = f.read()
    return out
