"""Registered queries by theme."""

from importlib import import_module

THEMES = ("tabular", "text", "sources", "vectors", "experience", "models", "media")


def load_all() -> None:
    for theme in THEMES:
        import_module(f"{__name__}.{theme}")
