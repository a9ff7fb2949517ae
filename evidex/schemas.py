"""Table schemas of the event base."""

from __future__ import annotations

SOURCES = (
    "id string, name string, org string, source_class string, channel string, channel_ref string, affiliated_with string, "
    "note string, domains array<string>, reliability double, partial_content boolean, active boolean"
)
ITEMS = (
    "id string, url string, url_canonical string, title string, content string, source_id string, source_class string, "
    "original_source string, effective_class string, published_at timestamp, discovered_at timestamp, time_source string, "
    "run_id string, channel string, simhash bigint, status string, event_id string, draft_stage string"
)
EVENTS = (
    "id string, event_key string, title string, summary string, company string, stage string, stage_basis string, "
    "confidence string, status string, review_state string, domains array<string>, first_seen_at timestamp, "
    "last_update_at timestamp, event_date date, independent_orgs int"
)
CLAIMS = (
    "id string, event_id string, kind string, text string, source_item_id string, based_on string, attributed_to string, "
    "audience string, needs_internal_data boolean"
)
EDGES = "from_event string, to_event string, relation string, basis string, created_by string"
REJECTS = (
    "run_id string, item_id string, url string, title string, source_id string, source_name string, stage string, "
    "reason_code string, reason_detail string, merged_into string, created_at timestamp"
)
RUNS = "id string, started_at timestamp, finished_at timestamp, mode string, dataset string, config_hash string, stats string, cost string"
REVIEWS = "target_type string, target_id string, action string, note string, reviewer string, created_at timestamp"
REPORTS = "id string, period_start date, period_end date, headline string, run_id string, body string, generated_at timestamp"
DRAFT = (
    "relevant boolean, company string, domains array<string>, event_key string, event_title string, summary string, stage string, "
    "event_date string, facts array<string>, inferences array<struct<text: string, attributed_to: string>>, "
    "original_source_hint string, note string, implication struct<text: string, audience: string, needs_internal_data: boolean>"
)

TABLES = {
    "sources": SOURCES, "items": ITEMS, "events": EVENTS, "claims": CLAIMS, "edges": EDGES,
    "rejects": REJECTS, "runs": RUNS, "reviews": REVIEWS, "reports": REPORTS,
}

#: Values that a column takes when a replaced row doesn't give it.
DEFAULTS = {
    "sources": {"reliability": 1.0},
    "items": {"status": "pending"},
    "events": {"review_state": "none", "independent_orgs": 0},
    "claims": {}, "edges": {}, "rejects": {}, "runs": {}, "reviews": {}, "reports": {},
}
KEYS = {"sources": "id", "items": "id", "events": "id", "claims": "id", "runs": "id", "reports": "id"}
