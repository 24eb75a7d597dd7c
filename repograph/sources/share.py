"""What travels with a shared graph: its metadata, its tags, and copies of the store's folder."""

from __future__ import annotations

import hashlib
import shutil
from pathlib import Path

MOVING_TAG = "latest"
_SPACE = "org.repograph.graph."
_REVISION = "org.opencontainers.image.revision"
_KEYS = {"commit": "commit", "branch": "branch", "created": "created", "files": "files", "symbols": "symbols", "version": "version", "digest": "digest"}


def annotations(meta: dict[str, str | None]) -> dict[str, str]:
    """Metadata as annotations; what is empty is left out, the commit stands under the common name as well."""
    out = {_SPACE + k: str(meta[f]) for f, k in _KEYS.items() if meta.get(f)}
    return out | ({_REVISION: str(meta["commit"])} if meta.get("commit") else {})


def metadata(noted: dict[str, str]) -> dict[str, str]:
    out = {f: noted[_SPACE + k] for f, k in _KEYS.items() if noted.get(_SPACE + k)}
    if "commit" not in out and noted.get(_REVISION):
        out["commit"] = noted[_REVISION]
    return out


def pull_tag(explicit: str | None) -> str:
    return explicit or MOVING_TAG


def push_tags(explicit: str | None, short_commit: str | None) -> list[str]:
    """The tag asked for or that of the commit, and the moving one; each once."""
    return list(dict.fromkeys([*([explicit or short_commit] if explicit or short_commit else []), MOVING_TAG]))


def digest(folder: str) -> str:
    """One hash of all files below a folder, by their relative paths."""
    out = hashlib.sha256()
    for p in sorted(Path(folder).rglob("*")):
        if p.is_file():
            out.update(f"{p.relative_to(folder)}\0{hashlib.sha256(p.read_bytes()).hexdigest()}\n".encode())
    return out.hexdigest()


def copy(source: str, target: str, want: str | None = None) -> str:
    """Copies a graph's folder in place of target and checks its digest; a wrong copy is not put in place."""
    part = Path(f"{target}.part")
    shutil.rmtree(part, ignore_errors=True)
    shutil.copytree(source, part)
    got = digest(str(part))
    if want is not None and got != want:
        shutil.rmtree(part)
        raise ValueError(f"digest of the graph is {got}, not {want}")
    shutil.rmtree(target, ignore_errors=True)
    part.rename(target)
    return got
