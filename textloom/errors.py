"""Errors that the engine raises."""

from __future__ import annotations


class EngineError(Exception):
    """Anything that ends a run."""


class ConfigError(EngineError):
    """Options that can't be used."""


class FileReadError(EngineError):
    """A file that couldn't be read, in strict mode."""
