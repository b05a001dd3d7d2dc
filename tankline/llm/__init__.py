"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from tankline.llm.oracles import oracles
from tankline.llm.queries import QUERIES

__all__ = ["QUERIES", "oracles"]
