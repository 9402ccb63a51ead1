"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

CHUNKS = (
    "chunk_id string, collection string, document string, embedding array<float>, source string, type string, chunk_index int, ts timestamp, "
    "sha256 string, title string, heading_path string, tags array<string>, links array<string>, top_folder string, original_file string, "
    "sparse_lexicon map<string,double>, extra map<string,string>, run string"
)
LEDGER = "rel_path string, sha256 string, mtime double, size long, collection string, chunk_count int, ingested_at timestamp, run string"
PROGRESS = "rel_path string, sha256 string, run string"
NOTES = "rel_path string, top_folder string, sha256 string, mtime double, size long, text string"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
CONCEPTS = (
    "concept_id string, concept_name string, mention_count long, enrichment_level int, first_seen timestamp, last_seen timestamp, needs_review boolean, "
    "summary string, confidence double, key_facts array<string>, contradictions array<string>, open_questions array<string>, related array<string>, run string"
)
TIMELINE = "concept_id string, seq int, ts timestamp, event string, source_hash string, evidence_count long, run string"
