"""Reference tables of relations and words, and the engine's parameters.

Values below must equal the original service's for right results: names of relations, aliases, slots, word lists.
"""

from __future__ import annotations

# How a relation is stored.
SINGULAR = ("IS", "WORKS_AT", "LIVES_IN", "HAS_ROLE", "GOAL_IS", "BORN_IN", "SWITCHED_TO", "STUDIES_AT")
MULTI = (
    "USES", "PREFERS", "KNOWS", "LEARNING", "HAS_SKILL", "SPEAKS", "INTERESTED_IN", "ENJOYS",
    "DISLIKES", "SWITCHED_FROM", "WORKS_ON", "BUILDING", "STRUGGLES_WITH", "HAS", "HAS_PET", "PLAYS",
)
TEMPORAL = ("LIVED_IN", "WORKED_AT", "STUDIED_AT", "VISITED", "TRAVELED_TO", "MET", "PLAYED")
DEFAULT_BEHAVIOR = "multi"
BEHAVIOR = {r: kind for kind, own in (("singular", SINGULAR), ("multi", MULTI), ("temporal", TEMPORAL)) for r in own}

# Phrases of each relation.
PHRASES = {
    "WORKS_AT": ("works at", "work at", "employed by", "job at", "works for", "work for"),
    "LIVES_IN": ("lives in", "live in", "resides in", "based in", "moved to"),
    "USES": ("uses", "use", "works with", "codes in", "coding in"),
    "PREFERS": ("prefers", "prefer", "likes", "like", "loves", "favorite"),
    "DISLIKES": ("dislikes", "hates"),
    "LEARNING": ("learning", "studying", "picking up"),
    "KNOWS": ("knows",),
    "HAS_SKILL": ("has skill", "skilled in"),
    "SPEAKS": ("speaks",),
    "IS": ("is", "is a", "is an"),
    "HAS_ROLE": ("has role", "role is", "works as"),
    "GOAL_IS": ("goal is", "goal", "wants to"),
    "STUDIES_AT": ("studies at", "studying at"),
    "BORN_IN": ("born in",),
    "SWITCHED_TO": ("switched to", "moved to stack"),
    "SWITCHED_FROM": ("switched from",),
    "INTERESTED_IN": ("interested in",),
    "ENJOYS": ("enjoys",),
    "WORKS_ON": ("works on", "working on"),
    "BUILDING": ("building",),
    "STRUGGLES_WITH": ("struggles with",),
    "LIVED_IN": ("lived in",),
    "WORKED_AT": ("worked at",),
    "STUDIED_AT": ("studied at",),
    "VISITED": ("visited",),
    "TRAVELED_TO": ("traveled to",),
    "MET": ("met",),
    "PLAYED": ("played", "used to play"),
    "PLAYS": ("plays", "play", "playing"),
    "HAS_PET": ("has pet", "has pets", "live with", "lives with"),
}
ALIASES = [(phrase, relation) for relation, own in PHRASES.items() for phrase in own]

# Labels for a relation extractor.
EXTRACTION_LABELS = (
    "works at", "lives in", "uses", "prefers", "dislikes", "learning", "knows", "speaks", "is", "has role", "goal is",
    "studies at", "born in", "switched to", "switched from", "interested in", "works on", "building", "has pet", "plays", "played",
)

# Descriptions for matching by meaning.
DESCRIPTIONS = {
    "WORKS_AT": "current employer or organization the user works for",
    "WORKED_AT": "past employer the user no longer works for",
    "HAS_ROLE": "current job title or professional role",
    "LIVES_IN": "current location or city of residence",
    "USES": "tool, programming language, or technology currently used",
    "PREFERS": "preference or favorite among options",
}

# Which facts compete, replace or mean the same.
SLOTS = {"IS": "role", "HAS_ROLE": "role", "WORKS_AT": "employer", "LIVES_IN": "residence", "BORN_IN": "origin", "GOAL_IS": "goal"}
TRANSITIONS = ("SWITCHED_FROM", "SWITCHED_TO")
BLACKLIST = ("BORN_IN", "SWITCHED_FROM", "SWITCHED_TO")
PAST_EMPLOYMENT, CURRENT_EMPLOYMENT = ("WORKED_AT",), ("WORKS_AT",)
FAMILIES = {"WORKS_AT": "employment", "WORKED_AT": "employment", "SWITCHED_FROM": "employment", "LIVES_IN": "location", "LIVED_IN": "location", "BORN_IN": "location"}
SUPERSEDES = {"LIVES_IN": ("BORN_IN", "LIVED_IN"), "WORKS_AT": ("WORKED_AT", "SWITCHED_FROM", "SWITCHED_TO")}

# Guards on extracted facts.
HIGH_RISK = ("BORN_IN", "LIVED_IN", "WORKED_AT", "VISITED", "MET")
TECHNOLOGY = (
    "python", "go", "golang", "rust", "typescript", "javascript", "java", "c++", "ruby", "fastapi", "django", "react",
    "vue", "docker", "kubernetes", "cursor", "vscode", "vim", "sqlite", "postgres", "redis", "qdrant", "langchain",
)
COMPANY_LIKE = r"(?i)\b(?:inc|llc|labs|corp|corporation|company|google|deepmind|stripe|slice|microsoft|amazon|meta|apple)\b"
ENGAGEMENT = {"LEARNING": 60, "HAS_SKILL": 55, "PLAYS": 50, "PLAYED": 45, "USES": 40, "ENJOYS": 30, "INTERESTED_IN": 20, "PREFERS": 10}
NOT_LOCATIONS = ("cat", "cats", "dog", "dogs", "pet", "pets", "guitar", "piano", "car", "bike", "luna", "milo")
ANIMALS = ("cat", "cats", "dog", "dogs", "pet", "pets", "luna", "milo")
LOCATION_LIKE = r"(?i)\b(?:city|town|state|country|street|avenue|delhi|london|paris|san francisco|new york|bangalore|mumbai|berlin|tokyo)\b"
TIER_STATUS = {"confirmed": "confirmed", "fuzzy": "fuzzy", "unknown": "unknown", "reject": "rejected"}
BORN = r"(?i)\b(?:born|birth)\b"
PAST_TENSE = r"(?i)\b(?:used to work(?:\s+at|\s+for)?|previously worked(?:\s+at|\s+for)?|was at|worked at|worked for|had worked(?:\s+at|\s+for)?)\b"
EXHAUSTIVE = r"(?i)\b(?:mainly use|mostly use|primarily use|only use|just use|work with|working with|I use)\b"
PET_LIVING, PET = r"\b(?:live|lives|living)\s+with\b", r"\b(?:cat|cats|dog|dogs|pet|pets|luna|milo)\b"

# Profile keys, and the order of storing.
PROFILE_KEYS = {"IS": "role", "HAS_ROLE": "role", "WORKS_AT": "company", "WORKS_ON": "current_project", "GOAL_IS": "goal", "LIVES_IN": "location"}
STORE_PRIORITY = {"WORKS_AT": 0, "IS": 0, "HAS_ROLE": 0, "LIVES_IN": 0, "USES": 5, "PREFERS": 5}
DEFAULT_PRIORITY = 3

# Limits.
RRF_K, RETRIEVE_LIMIT, SEARCH_LIMIT, API_LIMIT = 60, 50, 20, 10
OBJECT_WORDS_EXTRACT, OBJECT_WORDS_STORE = 3, 5
MISSING_PAIR_CONFIDENCE = 0.75
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

#: Parameters the original leaves to its settings; the values here are this engine's own.
FUZZY_THRESHOLD, SEMANTIC_THRESHOLD = 0.7, 0.55
PROMOTE_COUNT, PROMOTE_CONFIDENCE = 20, 0.7
STORE_THRESHOLD, REVIEW_THRESHOLD, HIGH_CONFIDENCE = 0.7, 0.4, 0.8
CONFIDENCE_STORE_THRESHOLD = 0.6
DEDUP_THRESHOLD, CONFLICT_THRESHOLD = 0.95, 0.9
#: From here up to DEDUP_THRESHOLD a model says whether two facts are the same.
DEDUP_MODEL_THRESHOLD = 0.85
TOKEN_BUDGET, RETENTION_DAYS = 2000, 30
