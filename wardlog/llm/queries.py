"""All registered queries of this subpackage."""

from wardlog.llm import (  # noqa: F401
    conversation_repair, decontamination, html_text, license_scan, neardup, packing, preference, quality_classifier,
    quality_rules, sentence_pieces, url_filter, vector_codes, warc)
from wardlog.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
