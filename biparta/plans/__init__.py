"""Registered queries: each family module adds its queries to ``registry``."""

from importlib import import_module

FAMILIES = ["tables", "graphs", "ranks", "temporal", "learning", "streams"]


def load_all() -> None:
    for name in FAMILIES:
        import_module(f"biparta.plans.{name}")
