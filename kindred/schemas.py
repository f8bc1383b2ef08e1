"""Fixed schemas of the tables that are read and made."""

from __future__ import annotations

VALIDATION = (
    "artist_name string, expected_similar string, category string, expected_country string, expected_type string, "
    "expected_ended string, disambiguation_hint string, manual_identity_status string, notes string"
)
LEDGER = "source string, field string, use_in_mvp string, license_class string, purpose string, notes string"
CANDIDATE = (
    "struct<id: string, name: string, score: string, country: string, type: string, disambiguation: string, "
    "`life-span`: struct<ended: boolean>, aliases: array<struct<name: string>>>"
)
#: One line of a candidate snapshot: the searched name, its status (``ok`` or an error text), the ranked candidates, and when it was taken.
SEARCH = f"artist_name string, error string, artists array<{CANDIDATE}>, fetched_at timestamp"
#: One line of a listener-statistics snapshot; no payload stands for "no content".
STATS = "mbid string, error string, payload struct<total_listen_count: string, listeners: array<struct<user_name: string, listen_count: bigint>>, last_updated: string>, fetched_at timestamp"
TRIPLES = "subject string, property string, object string"
LISTENS = "user_identifier string, recording_mbid string, listen_timestamp timestamp"
CANONICAL = "recording_mbid string, artist_mbid string"
EDGES = (
    "source_artist_id string, target_artist_id string, total_score double, behavior_score double, metadata_score double, "
    "relation_score double, confidence string, common_listener_bucket string, is_fallback boolean, model_version string"
)
FEEDBACK = "pseudonymous_user_id string, artist_id string, action string, created_at timestamp, model_version string"
#: One line of a catalogue dump, as far as it is used.
DUMP = (
    "id string, name string, `sort-name` string, type string, country string, disambiguation string, "
    "`life-span` struct<begin: string, `end`: string, ended: boolean>, aliases array<struct<name: string>>"
)
REGISTRY = "source_name string, snapshot_date date, checksum string, license_class string, path string, checked_at timestamp"
