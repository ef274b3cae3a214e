"""Job defaults. They must equal the published ones for equal results."""

RRF_K = 60
KEYWORD_TERMS = 16
LEARNING_TEXT_CAP = 500
RECALL_FLOOR = 0.75
SKILL_FLOOR = 0.80
PATTERN_EDGE_FLOOR = 0.65
SALIENCE_WEIGHT = 0.1
SALIENCE_DECAY = 0.9
SALIENCE_POOL = 3
SKILL_THRESHOLD = 4
SKILL_MIN_CLUSTER = 2
SKILL_PROPOSALS_PER_RUN = 2
PROFILE_THRESHOLD = 5
BLOCKED_WINDOW_DAYS = 7
INJECTION_WINDOW_SECONDS = 120

CREATE_TOUCH_WEIGHT = 2.0
UPDATE_TOUCH_WEIGHT = 1.0
GROUP_EDGE_WEIGHT = 1.0
MAX_GROUP_SIZE = 50
SIMILAR_TOP_K = 5
SIMILAR_FLOOR = 0.65
SIMILAR_EDGE_WEIGHT = 0.5
DAMPING = 0.5
MAX_ITERATIONS = 50
TOLERANCE = 1e-7

EDGE_TOP_K = 10
MAX_COMMUNITY_SIZE = 20
REVIEW_BUDGET = 10
GATE_TOP_K = 15
SWEEP_LIMIT = 8

EXTRACTION_WINDOW = 200
ENRICHMENT_WINDOW = 400
CORPUS_CHARS = 12000
EMBED_BATCH = 64

MAX_RESPONSE_CHARS = 4000
MAX_FIELD_CHARS = 8000
MAX_ERROR_CHARS = 1000
MAX_LISTED = 20
MAX_LINE_CHARS = 200

INTERVAL_HOURS = {"profile": 24, "skills": 24, "pattern_merge": 8, "salience": 4}

BM25_K1 = 1.2
BM25_B = 0.75

LIVE_STATUSES = ("approved", "candidate")
