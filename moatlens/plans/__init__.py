"""Query catalog: importing this package registers every query key."""

from moatlens.plans import q_filings, q_fin, q_misc, q_pricing, q_snap, q_text, q_urls  # noqa: F401
from moatlens.plans.registry import ORACLES, QUERIES  # noqa: F401
