"""Operators of a training-data pipeline. Nothing outside this subpackage imports it."""

from . import contamination, language, licenses, lines, media, mixing, near, pii, suffixes, toxicity

_MODULES = (media, licenses, near, suffixes, language, lines, toxicity, contamination, mixing, pii)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
