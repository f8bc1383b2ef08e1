"""Constants, and the decisions taken where the specification leaves a gap."""

from __future__ import annotations

from dataclasses import dataclass

#: Candidate scoring (fixed values): share of the search score, then the points of each match.
API_SHARE, EXACT_NAME, COUNTRY, TYPE, ENDED, HINT = 0.40, 30, 10, 8, 5, 7
STRONG_TOTAL, STRONG_GAP = 88, 8
FORCED_REVIEW = "ambiguous_name"
#: Notes of a resolution (fixed values).
NO_CANDIDATES, CONFIRM = "MusicBrainz returned no candidates", "Confirm the selected MBID manually"
CANDIDATE_LIMIT, TOP_CANDIDATES = 5, 3
CANDIDATE_RATE, DATA_RATE = 0.90, 0.70
VALIDATION_ROWS = 50
#: Targets of the report's lines; what has none is a diagnosis.
TARGETS = {"musicbrainz_candidate_rate": CANDIDATE_RATE, "listenbrainz_data_rate": DATA_RATE, "identity_pending_count": 0, "identity_incorrect_count": 0}


@dataclass(frozen=True)
class Similarity:
    play_cap: int = 20  # plays of one artist by one user
    user_cap: int = 50  # artists of one user that enter pairs
    min_listeners: int = 5  # of an artist
    min_common: int = 20  # listeners of a published edge
    shrinkage: float = 20.0
    behavior: float = 0.80
    metadata: float = 0.15
    relation: float = 0.05
    high_common: int = 50
    medium_common: int = 20
    enough_metadata: float = 0.5
    top_k: int = 50
    session_minutes: int = 30
    outlier_width: float = 6.0  # deviations from a user's median of plays a day
    outlier_floor: float = 5.0  # plays; least deviation that counts
    outlier_days: int = 7  # days that a user must have


@dataclass(frozen=True)
class Ranking:
    best: float = 0.6
    mean: float = 0.4
    mmr_alpha: float = 0.7
    results: int = 10
    candidates: int = 250
    long_tail: float = 0.8
    popularity_penalty: float = 0.1  # of the fit, for the most popular artist, in adventure mode


#: Relation kinds and their weights; a shared label alone is no evidence.
RELATIONS = {"shared_member": 1.0, "side_project": 0.8, "collaboration": 0.6, "direct": 0.5}
