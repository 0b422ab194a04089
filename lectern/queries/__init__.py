"""Queries over the tables, one an operator, each with its SQL where SQL can say it."""

from lectern.queries import books, cleaning, library, shelf, speaking, tracking  # noqa: F401
from lectern.queries.registry import ORACLES, QUERIES  # noqa: F401
