"""Importing this module registers the operators' queries."""

from lumenfit.llm import (  # noqa: F401
    exactdedup, hnsw, langid, linededup, merkle, mixing, pieces, quality, secrets, simhash, tokencount, toxicity, whitening,
)
from lumenfit.llm.registry import ORACLES, QUERIES  # noqa: F401
