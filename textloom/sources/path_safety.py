"""Checks of paths before anything is read."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from ..errors import ConfigError, EngineError


def _parts(path: str) -> list[str]:
    return [p for p in path.split("/") if p not in ("", ".")]


def is_path_safe(path: str) -> bool:
    """No NUL, and no point at which more .. than names have come. The file system isn't looked at."""
    depth = 0
    for part in _parts(path):
        depth += -1 if part == ".." else 1
        if depth < 0:
            return False
    return "\0" not in path


@dataclass
class SanitizeOptions:
    allow_symlinks: bool = False
    allowed_roots: list[str] = field(default_factory=list)
    max_depth: int = 256
    reject_null_bytes: bool = True


@dataclass
class SanitizedPath:
    original: str
    canonical: str
    was_symlink: bool


def sanitize_path(path: str, options: SanitizeOptions | None = None) -> SanitizedPath:
    """The path resolved, if it passes: NUL, depth, .. where roots are given, symbolic link, existence, roots, in this order."""
    options = options or SanitizeOptions()
    if options.reject_null_bytes and "\0" in path:
        raise ConfigError("Path contains null bytes")
    depth = sum(p != ".." for p in _parts(path))
    if depth > options.max_depth:
        raise ConfigError(f"Path exceeds maximum depth of {options.max_depth} (found {depth})")
    if options.allowed_roots and ".." in _parts(path):
        raise ConfigError("Path traversal attempt detected (contains '..')")
    link = os.path.islink(path)
    if link and not options.allow_symlinks:
        raise ConfigError(f"Symbolic links are not allowed: {path}")
    try:
        real = os.path.realpath(path, strict=True)
    except OSError as bad:
        raise EngineError(f"Failed to canonicalize path '{path}': {bad}") from bad
    roots = [os.path.realpath(r) for r in options.allowed_roots if os.path.exists(r)]
    if options.allowed_roots and not any(os.path.commonpath([real, r]) == r for r in roots):
        raise ConfigError(f"Path '{path}' is outside allowed directories")
    return SanitizedPath(path, real, link)


def sanitize_paths(paths: list[str], options: SanitizeOptions | None = None) -> list[SanitizedPath]:
    return [sanitize_path(p, options) for p in paths]
