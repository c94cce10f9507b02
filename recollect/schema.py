"""Schemas of the stored tables."""

EPISODES = "id string, user_id string, role string, content string, created_at timestamp_ntz, session_id string, metadata string"
EDGES = (
    "id string, user_id string, subject string, relation string, object string, fact_string string, review_status string, "
    "episode_id string, confidence double, valid_at timestamp_ntz, invalid_at timestamp_ntz, created_at timestamp_ntz, retracted_at timestamp_ntz"
)
PROFILE = "user_id string, key string, value string, value_type string, updated_at timestamp_ntz"
