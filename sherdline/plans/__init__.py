"""Views, registered queries and their checks."""

import importlib

GROUPS = (
    "catalogue_queries change_queries relation_queries metric_queries ranking_queries "
    "model_queries contour_queries matching_queries ruler_queries source_queries known_queries"
).split()


def load_all() -> None:
    for group in GROUPS:
        importlib.import_module(f"{__name__}.{group}")
