"""The seeder: four root documents and the folders of a new knowledge base; a plan first, then its commit."""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from folioscope.functions.text import AREAS

FOLDERS = (*AREAS, "sdd/changes", "sdd/archives")


@dataclass
class Step:
    path: str
    action: str  # create, keep or overwrite
    content: str | None = None  # None for a folder


def documents(url: str | None = None) -> dict[str, str]:
    where = f"\nSource: {url}\n" if url else ""
    return {
        "AGENTS.md": f"# Agents\n\nRead index.md first, then search before you answer. Cite pages by path and line.{where}",
        "index.md": "# Index\n\n" + "\n".join(f"- {a}/" for a in AREAS) + "\n",
        "SDD.md": "# Specifications\n\nA change lives in sdd/changes/<id> with spec/ and tasks/; verify it, then archive it.\n",
        "log.md": f"# Log\n\n## [{datetime.now(UTC):%Y-%m-%d}] init\n\nCreated the knowledge base.\n",
    }


def plan(root: str, url: str | None = None, force: bool = False) -> list[Step]:
    top = Path(root)
    if top.exists() and not top.is_dir():
        raise NotADirectoryError(root)
    steps = []
    for name, content in documents(url).items():
        file = top / name
        if file.is_dir():
            raise IsADirectoryError(str(file))
        steps.append(Step(name, "create" if not file.exists() else "overwrite" if force else "keep", content))
    for name in FOLDERS:
        folder = top / name
        if folder.exists() and not folder.is_dir():
            raise NotADirectoryError(str(folder))
        steps.append(Step(name, "keep" if folder.exists() else "create"))
    return steps


def commit(root: str, steps: list[Step]) -> int:
    """Carries the plan out; how many documents were written."""
    top, n = Path(root), 0
    top.mkdir(parents=True, exist_ok=True)
    for s in steps:
        if s.content is None:
            (top / s.path).mkdir(parents=True, exist_ok=True)
        elif s.action != "keep":
            staged = top / (s.path + ".new")
            staged.write_text(s.content, encoding="utf-8")
            os.replace(staged, top / s.path)
            n += 1
    return n
