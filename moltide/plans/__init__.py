"""Registered queries."""

from . import catalogue, more, stored

__all__ = ["catalogue", "more", "stored"]
