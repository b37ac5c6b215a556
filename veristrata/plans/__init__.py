"""Queries over the driver's tables and their SQL; importing the package registers all of them."""

from . import corpus, extended, landed, lookups, registry, rules  # noqa: F401
