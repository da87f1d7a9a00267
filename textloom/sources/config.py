"""Where rules and corpora come from: a stated path, an environment variable, the working folder, the home folder."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from pathlib import Path


def resolve(flag: str | None, env: str, names: tuple[str, ...]) -> tuple[Path | None, bool]:
    """(path, whether it was stated): the first that exists, or the stated one whether it exists or not."""
    if flag:
        return Path(flag), True
    if os.environ.get(env):
        return Path(os.environ[env]), True
    for folder in (Path.cwd(), Path.home()):
        for name in names:
            if (folder / name).is_file():
                return folder / name, False
    return None, False


def load(flag: str | None, env: str, names: tuple[str, ...], parse: Callable[[str], list], otherwise, strict: bool = False):
    """What parse makes of the file found. A stated (or strict) bad file is an error, a found one a warning and otherwise."""
    path, stated = resolve(flag, env, names)
    if path is None:
        return otherwise
    try:
        return parse(path.read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        if stated or strict:
            raise
        print(f"warning: {path}: {e}", file=sys.stderr)
        return otherwise
