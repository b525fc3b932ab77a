"""All registered queries outside the training-data subpackage."""

from __future__ import annotations

from tidewell.plans import audit_queries, evidence_queries, moments, relation_queries, review_queries, text_queries, work_queries  # noqa: F401
from tidewell.plans.catalog import QUERIES, SQL
from tidewell.plans.evidence_queries import evidence_quality_select

QUERIES.update(moments.QUERIES)
flagship = evidence_quality_select
