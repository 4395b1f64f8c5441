"""A git post-commit hook that updates the graph; other content of the hook file stays as it is."""

from __future__ import annotations

from pathlib import Path

BEGIN, END = "# codeweft hook begin", "# codeweft hook end"


def _file(root: str) -> Path:
    return Path(root) / ".git" / "hooks" / "post-commit"


def _without(text: str) -> str:
    head, _, rest = text.partition(BEGIN)
    return head + rest.partition(END)[2].lstrip("\n") if rest else text


def status(root: str) -> str:
    return "INSTALLED" if _file(root).exists() and BEGIN in _file(root).read_text() else "NOT_INSTALLED"


def install(root: str) -> None:
    """Adds the block once."""
    file = _file(root)
    text = _without(file.read_text()) if file.exists() else "#!/bin/sh\n"
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(f'{text.rstrip()}\n{BEGIN}\npython -m codeweft.cli build -p "$(git rev-parse --show-toplevel)" --update || true\n{END}\n')
    file.chmod(0o755)


def uninstall(root: str) -> None:
    file = _file(root)
    if file.exists():
        rest = _without(file.read_text())
        if rest.strip() in ("", "#!/bin/sh"):
            file.unlink()
        else:
            file.write_text(rest)
