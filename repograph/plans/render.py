"""Text, Markdown and JSON of results; bounded by what a user asked to see, never by a table."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from typing import Any

from ..functions.paths import FENCES

TOOL = "repograph"


def escape_cell(text: str) -> str:
    return text.replace("|", "\\|")


def fence_for(text: str) -> str:
    return "`" * (max(2, *(len(x) for x in re.findall("`+", text)), 0) + 1)


def number(n: int) -> str:
    return f"{n:,}"


def table(headers: Sequence[str], rows: Iterable[Sequence[Any]]) -> str:
    """Columns as wide as their widest cell, two blanks between, nothing at the ends of lines."""
    cells = [[str(c) for c in r] for r in rows]
    width = [max([len(h), *(len(r[i]) for r in cells if i < len(r))]) for i, h in enumerate(headers)]
    line = lambda r: "  ".join(c.ljust(width[i]) if i < len(width) else c for i, c in enumerate(r)).rstrip() + "\n"
    padded = [r + [""] * (len(headers) - len(r)) for r in cells]
    return line(list(headers)) + ("".join(map(line, padded)) if padded else "(no results)\n")


def related(seed: str, items: Iterable[dict]) -> str:
    out, last = [f"Related to {seed}\n"], None
    for item in items:
        if item["depth"] != last:
            out += [""] * (last is not None) + ["Direct:" if item["depth"] == 0 else "Related:"]
            last = item["depth"]
        out += [f"  {item['path']}", f"    reason: {item['reason']}"]
    return "\n".join(out) + "\n"


def pretty(value: Any) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def _ordered(symbols: Iterable[dict]) -> list[dict]:
    return sorted(symbols, key=lambda s: (s["file_path"], s["start_line"], s["name"], s["id"]))


def pack_markdown(request: dict, repository: dict, selection: Sequence[dict], symbols: Iterable[dict], contents: dict[str, str], diff: str | None = None, dry_run: bool = False) -> str:
    """request: mode, query, budget; repository: name, branch, commit; selection: path, tier, reason, tokens, included, language; contents by path."""
    out = ["# Context Pack", "", f"Generated by `{TOOL}`.", "", "## Request", "", f"- Mode: {request['mode']}", f"- Query: {request['query']}", f"- Budget: {request['budget']} tokens", ""]
    out += ["## Selection Summary", "", "| File | Reason | Estimated Tokens |", "|---|---|---:|"]
    out += [f"| {escape_cell(f['path'])} | {escape_cell(f['reason'])} | {f['tokens']} |" for f in selection]
    out += ["", "## Repository Metadata", "", f"- Repo: {repository.get('name') or '(unnamed)'}", f"- Branch: {repository.get('branch') or '(unknown)'}", f"- Commit: {repository.get('commit') or '(unknown)'}"]
    out += [f"- Changed files included: {'yes' if request['mode'] == 'changed' else 'no'}", "- Graph backend: Parquet", "", "## Symbols", ""]
    rows = _ordered(symbols)
    if rows:
        out += ["| Symbol | Kind | Language | File |", "|---|---|---|---|"]
        out += [f"| {escape_cell(s['name'])} | {s['kind']} | {s['language']} | {escape_cell(s['file_path'])} |" for s in rows]
    else:
        out.append("_No symbols extracted for the selected files._")
    out.append("")
    block = lambda text, word: [fence_for(text) + word, text[:-1] if text.endswith("\n") else text, fence_for(text), ""]
    if diff:
        out += ["## Diff", "", *block(diff, "diff")]
    if not dry_run:
        out += ["## Files", ""]
        for f in selection:
            if f["included"]:
                out += [f"### {f['path']}", "", f"Reason: {f['reason']}", "", *block(contents.get(f["path"], ""), FENCES.get(f["language"], f["language"]))]
    return "\n".join(out) + "\n"


def pack_json(request: dict, repository: dict, selection: Sequence[dict], symbols: Iterable[dict], contents: dict[str, str], diff: str | None = None, dry_run: bool = False) -> str:
    names = {"name": "name", "fullName": "full_name", "kind": "kind", "language": "language", "file": "file_path", "startLine": "start_line", "endLine": "end_line", "exported": "exported"}
    doc = {
        "tool": TOOL,
        "request": {"mode": request["mode"], "query": request["query"], "budget": request["budget"], "dryRun": dry_run},
        "repository": {"name": repository.get("name") or None, "branch": repository.get("branch"), "commit": repository.get("commit"), "changedFilesIncluded": request["mode"] == "changed", "graphBackend": "Parquet"},
        "selection": [{"path": f["path"], "reason": f["reason"], "tier": f["tier"], "estimatedTokens": f["tokens"], "included": f["included"]} for f in selection],
        "symbols": [{k: s[v] for k, v in names.items()} for s in _ordered(symbols)],
        "files": [] if dry_run else [{"path": f["path"], "reason": f["reason"], "language": f["language"], "contents": contents.get(f["path"], "")} for f in selection if f["included"]],
    }
    return pretty(doc | ({"diff": diff} if diff else {}))


def status(values: dict) -> str:
    """The lines of a status report from its JSON values."""
    out = [f"Repo: {values['repo'] or '(unnamed)'}", f"Index: {values['index']}", f"Graph backend: {values['graphBackend']}", f"Graph path: {values['graphPath']}"]
    named = {"Files indexed": "filesIndexed", "Symbols indexed": "symbolsIndexed", "Reference edges": "referenceEdges", "Stale files": "staleFiles", "Untracked files": "untrackedFiles"}
    out += [f"{k}: {number(values[v])}" for k, v in named.items()]
    out += [f"Last index: {values['lastIndex']}"] * bool(values["lastIndex"])
    if o := values.get("origin"):
        out.append(f"Origin: {o.get('registry', '?')}/{o.get('repository', '?')}:{o.get('tag', '?')} (commit {o.get('commit') or '?'})")
    return "\n".join(out) + "\n"
