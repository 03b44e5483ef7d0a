"""Registered queries of this folder, and their SQL twins."""

from . import byte_bpe, fingerprints, hard_negatives, jaccard_regions, license_scan, mixing, near_dup, pii, quality_model, quality_rules, secret_scan, templates, token_alignment  # noqa: F401
from .common import REGISTRY, SQL  # noqa: F401
