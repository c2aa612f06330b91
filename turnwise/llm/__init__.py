"""Operators of a training-data pipeline; nothing outside this folder imports them."""
from turnwise.llm.queries import ORACLES, QUERIES  # noqa: F401
