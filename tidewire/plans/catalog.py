"""All registered queries of the press-release engine and the SQL that checks them."""

from tidewire.plans import q_alerts, q_dedup, q_evaluate, q_feed, q_model, q_scans, q_score, q_texts  # noqa: F401  (they register)
from tidewire.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "feed_classes"
