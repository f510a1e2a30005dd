"""Declared schemas of events, drafts and state tables."""

from __future__ import annotations

SOURCE = "struct<source_id: string, name: string, domain: string, url: string, title: string, author: string, published_at: string, source_type: string, is_primary: boolean>"
EVENT = f"contract_version string, event_key string, revision int, topic string, title string, first_seen string, last_seen string, is_multi_source boolean, source_count int, cluster_confidence double, cursor string, sources array<{SOURCE}>, metadata string, payload_hash string"
ISSUE = "struct<code: string, severity: string, field: string>"
RULE = "struct<code: string, severity: string, triggered: boolean, evidence: array<string>>"
DRAFT = """draft_id string, article_id string, event_key string, revision int, status string,
 content struct<title: string, body_html: string, subtitle: string, summary: string, meta_description: string, slug_suggestion: string, category_suggestions: array<string>, tag_suggestions: array<string>>,
 sources array<struct<url: string, source_id: string, name: string, domain: string, title: string, extraction_status: string, is_primary: boolean>>,
 evidence array<struct<evidence_id: string, source_url: string, source_name: string, source_excerpt: string, claim: string, status: string>>,
 media_candidates array<struct<source_url: string, source_domain: string, original_alt: string, original_caption: string, credit: string, license: string, media_type: string, status: string>>,
 warnings array<string>, blocking_errors array<string>,
 provenance struct<input_hash: string, output_hash: string, pipeline_version: string, commit_sha: string, input_contract_version: string, input_event_key: string, input_payload_hash: string, input_revision: int, prompt_version: string>"""
