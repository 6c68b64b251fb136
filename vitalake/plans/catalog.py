"""All registered queries."""

from vitalake.plans import q_audit, q_extract, q_mapping, q_merge, q_nested, q_retrieval, q_sections, q_sources, q_streaming, q_text, q_validate  # noqa: F401
from vitalake.plans.registry import ENTRIES

__all__ = ["ENTRIES"]
