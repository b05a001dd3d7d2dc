from .oracles import oracles
from .queries import QUERIES

__all__ = ["QUERIES", "oracles"]
