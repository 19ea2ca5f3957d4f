"""Schemas of the records that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


INDEX_ROW = _struct(arxiv_id=_S, rank=_L, upvotes=_L, pdf_failed=_B, pdf_status=_S, topic_score=_D, source=_S)
TERMS = _struct(must=T.ArrayType(_S), should=T.ArrayType(_S), negative=T.ArrayType(_S))
WEIGHTS = _struct(relevance=_D, freshness=_D, votes=_D)
INDEX = _struct(mode=_S, key=_S, generated_at=_S, total=_L, topic=_S, query=_S, display_name=_S, generated_terms=TERMS, papers=T.ArrayType(INDEX_ROW))
PAPER = _struct(
    arxiv_id=_S, stored_at=_S, title=_S, abstract=_S, authors=_S, submitted=_S, url=_S, pdf_url=_S, title_zh=_S, abstract_zh=_S, keywords_zh=T.ArrayType(_S), summary_zh=_S,
    pdf_status=_S, pdf_quality_tainted=_B, pdf_quality_taint_reason=_S, pdf_quality_tainted_at=_S,
)
PROFILE = _struct(slug=_S, query=_S, display_name=_S, enabled=_B, generated_terms=TERMS, categories=T.ArrayType(_S), weights=WEIGHTS, created_at=_S, updated_at=_S)
CANDIDATE = _struct(arxiv_id=_S, title=_S, abstract=_S, authors=_S, submitted=_S, url=_S, pdf_url=_S, categories=T.ArrayType(_S))
FAILURE = _struct(arxiv_id=_S, phase=_S, category=_S, family=_S, retry_strategy=_S, repair_action=_S, retryable=_B, suggestion=_S, evidence=_S)
BOOKMARK = _struct(list_id=_S, name=_S, created=_S, pos=_L, arxiv_id=_S, mode=_S, key=_S, added=_S)
EVENT = _struct(event_id=_L, ts=T.TimestampNTZType(), user_id=_L, event_type=_S, value=_D, props=_S)
