"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from panelweave.plans import models, prepare

QUERIES = {**prepare.QUERIES, **models.QUERIES}
ORACLES = {**prepare.ORACLES, **models.ORACLES}
