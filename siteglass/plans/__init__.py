"""Registered queries: the operators applied to whole tables, each with SQL that says the same."""

from . import details, documents, filters, folds, places, ranking, sinks, sources, workspace  # noqa: F401
from .ranking import search_flagship as flagship  # noqa: F401
