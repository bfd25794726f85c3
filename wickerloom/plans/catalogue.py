"""All queries of the core."""

from __future__ import annotations

from wickerloom.plans.documents import DOCUMENTS
from wickerloom.plans.heavy import HEAVY
from wickerloom.plans.more import MORE
from wickerloom.plans.profiles import PROFILES
from wickerloom.plans.registry import Query
from wickerloom.plans.serving import SERVING
from wickerloom.plans.splits import SPLITS
from wickerloom.plans.texts import TEXTS
from wickerloom.plans.vectors import VECTORS

REGISTRIES = [HEAVY, PROFILES, SPLITS, TEXTS, VECTORS, MORE, DOCUMENTS, SERVING]


def all_queries() -> dict[str, Query]:
    return {name: f for r in REGISTRIES for name, f in r.queries.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for r in REGISTRIES for name, sql in r.oracles.items()}
