"""Registered queries of the panel engine."""

from strandline.plans import flagship, kernels, more, research, windows  # noqa: F401
from strandline.plans import blocks, extended, recursions  # noqa: F401  isort: skip
from strandline.plans.registry import ORACLES, QUERIES  # noqa: F401
