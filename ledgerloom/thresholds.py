"""Constants that are part of the semantics; every scoring operator takes a ``Thresholds``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the scoring rules; results must match under the defaults."""

    confidence: float = 0.85
    rag_direct: float = 0.92
    top_k: int = 5
    similarity_floor: float = 0.65
    agreement_exponent: float = 0.3
    margin_safe: float = 0.08
    dampen_llm: float = 0.85
    dampen_rag: float = 0.92
    off_example_cap: float = 0.5
    machine_weight: float = 0.25
    consensus_floor: float = 0.6
    defer_cap: float = 0.5
    defer_llm: float = 0.85
    prior_weight: float = 2.0
    prior_min_obs: int = 2
    prior_dominance: float = 0.65
    learned_support: int = 3
    learned_purity: float = 0.9
    learned_confidence: float = 0.95
    apply_similar_floor: float = 0.9


#: Label sources by trust.
TRUSTED = ("manual", "rule", "imported")
MACHINE = ("llm", "rag_prompted", "rag_direct", "learned_rule")
MODEL = MACHINE + ("rule",)
REVIEWABLE = MODEL + ("model",)
VERIFIED = ("manual", "imported")

#: Categories that are no spending, and link types that offset spending.
NON_SPEND = ("Self Transfers", "Investments", "Transfers", "Income")
OFFSET_TYPES = ("split", "reimbursement", "refund")
SUBCATEGORY_ALIASES = {"cafes": "Cafe & Snacks", "restaurant": "Restaurants", "dining": "Restaurants", "concerts": "Events & Concerts"}
STOPPED_AFTER_DAYS = 45
FAMILY = ("dad", "mom", "father", "mother", "parent", "sister", "brother", "sibling", "wife", "husband", "spouse", "son", "daughter", "family")
UPI_NOISE = ("UPI", "NEFT", "IMPS", "RTGS", "NA", "NO REMARKS", "N/A", "NONE", "-")
