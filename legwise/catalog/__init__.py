"""Named queries over the bundled tables, each with an independent SQL twin."""

import importlib

SECTIONS = ("tables", "joins", "windows", "aggregates", "scalars", "quality", "evaluation", "models", "serving")


def load():
    """Import all sections; return the queries and the SQL twins."""
    for section in SECTIONS:
        importlib.import_module(f"legwise.catalog.{section}")
    from legwise.catalog.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
