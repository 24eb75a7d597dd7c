"""What git says of a work tree; where it can't be asked, nothing."""

from __future__ import annotations

import subprocess


def _run(root: str, *args: str) -> str | None:
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")
    except (OSError, subprocess.CalledProcessError):
        return None


def _lines(root: str, *args: str) -> set[str]:
    return {x for x in (_run(root, *args) or "").split("\0") if x}


def tracked_files(root: str) -> set[str]:
    return _lines(root, "ls-files", "-z")


def changed_files(root: str) -> list[str]:
    """Paths that differ from the last commit or the index, and untracked ones, sorted."""
    diffs = [("diff", "--name-only", "-z", "HEAD"), ("diff", "--name-only", "-z"), ("ls-files", "-z", "--others", "--exclude-standard")]
    return sorted(set().union(*(_lines(root, *d) for d in diffs)))


def info(root: str) -> dict[str, str | None]:
    """branch, short commit and full commit; None where there is none."""
    asked = {"branch": ("rev-parse", "--abbrev-ref", "HEAD"), "commit": ("rev-parse", "--short", "HEAD"), "full_commit": ("rev-parse", "HEAD")}
    return {k: (_run(root, *a) or "").strip() or None for k, a in asked.items()}


def diff(root: str) -> str | None:
    return _run(root, "diff", "HEAD") or None


def same_commit(graph: str | None, head: str | None) -> str:
    """match, mismatch or unknown: whether one commit name begins the other, in any case of letters."""
    if not graph or not head:
        return "unknown"
    a, b = graph.lower(), head.lower()
    n = min(len(a), len(b))
    return "match" if a[:n] == b[:n] else "mismatch"
