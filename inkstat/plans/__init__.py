"""Registered queries, one module per operator family."""

from importlib import import_module

FAMILIES = ("paired", "statistics", "redundancy", "structure", "measures", "matching", "corpus", "inout")


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"inkstat.plans.{family}")
