"""All registered queries of this subpackage and their SQL."""

from __future__ import annotations

from noisesift.llm import embeddings, html, language, licenses, manifest, minhash, mixing, packing, quality, runs, secrets, spotsigs, urls  # noqa: F401
from noisesift.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
