"""Registered queries: each operator on the stand-in views, with its SQL."""

from importlib import import_module

AREAS = ("q_ingest", "q_history", "q_sales", "q_search", "q_geo", "q_feeds", "q_taste", "q_alerts", "q_web", "q_reports", "q_streams")


def load():
    """Imports every area once and returns the registry."""
    for area in AREAS:
        import_module(f"{__name__}.{area}")
    return import_module(f"{__name__}.registry")
