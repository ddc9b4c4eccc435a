"""Fixed values of the data contract. Results depend on them, so they are kept as given."""

# --- fixed values: identifiers -------------------------------------------------
ID_HEX = 24
CANDIDATE_HEX = 32

# --- fixed values: message contract --------------------------------------------
PART_TYPES = ("text", "image", "audio", "video", "file", "link", "system")
TEXT_PART_TYPES = ("text", "system", "link")
DIRECTIONS = ("incoming", "outgoing", "system", "unknown")
CONVERSATION_TYPES = ("single", "group")
SCHEMA_VERSION_PATTERN = r"^[a-z-]+-import/v1$"
UNKNOWN_SENDER = "Unknown"
UNKNOWN_FILE = "unknown"

# --- fixed values: query limits (default, maximum) -----------------------------
LIMIT_LIST = (50, 200)
LIMIT_SEARCH = (20, 500)
LIMIT_CONTEXT = (5, 50)
LIMIT_PARTICIPANTS = (200, 500)
LIMIT_CANDIDATES = (50, 200)
LIMIT_DIGEST = (100, 500)
EXCERPTS_PER_CONVERSATION = 10
EXCERPT_CHARS = 240
TOP_SENDERS = 10
NO_TEXT_EXCERPT = "[attachment-only message]"
DIGEST_HEADER = (
    "# Deterministic inbox digest packet",
    "This packet is derived from normalized evidence; it is not an AI summary.",
    "Messages considered: ",
    "Additional messages omitted by limit: ",
)
ATTACHMENT_BYTES = (2097152, 26214400)

# --- fixed values: rule scan -----------------------------------------------------
TITLE_CHARS = 160
NO_TEXT_TITLE = "[无可提取文本]"
SIGNUP_DEADLINE_RULE = {
    "id": "signup-deadline-v1",
    "name": "报名与截止",
    "version": "1",
    "event_types": {
        "registration": ["报名", "招募", "登记", "申请"],
        "deadline": ["截止", "截至", "逾期"],
    },
    "combined": "registration_deadline",
}
REVIEW_STATES = ("REVIEW_REQUIRED", "APPROVED", "DISMISSED")

# --- fixed values: collector -------------------------------------------------------
FAILURE_STATES = ("REQUIRES_USER_ACTION", "RETRYABLE_ERROR")
COLLECTOR_STATES = (
    "BASELINE_ESTABLISHED",
    "OK_UNCHANGED",
    "CHANGE_OBSERVED",
    "REQUIRES_USER_ACTION",
    "RETRYABLE_ERROR",
)
OBSERVATION_SCOPES = (
    "source_profile_metadata",
    "explicit_export_metadata",
    "acquisition_readiness",
)
BACKOFF_CAP_SECONDS = 900.0
BACKOFF_MAX_DOUBLINGS = 10
READY_CAPABILITY = "PARTIAL_EXPORT"

# --- fixed values: sharded exports ---------------------------------------------------
MS_THRESHOLD = 100_000_000_000
LOW_32_BITS = 0xFFFF_FFFF
ZSTD_STORAGE = 4
VIDEO_DETAIL_TYPE = 131074
RESOURCE_MARKER = b"\x12\x22\x0a\x20"
RESOURCE_TYPES = ("image", "audio", "video", "file")
FORMAT_SIGNATURES = (
    # (format, first bytes, bytes from the ninth on or None), tested in this order
    ("wxgf", b"wxgf", None),
    ("jpg", b"\xff\xd8\xff", None),
    ("png", b"\x89PNG", None),
    ("gif", b"GIF87a", None),
    ("gif", b"GIF89a", None),
    ("webp", b"RIFF", b"WEBP"),
    ("tif", b"II*\x00", None),
    ("tif", b"MM\x00*", None),
    ("bmp", b"BM", None),
)
SQLITE_HEADER = b"SQLite format 3\x00"
MP4_BRAND = b"ftyp"

# --- fixed values: media types by extension --------------------------------------------
MIME_BESIDES = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "m4a": "audio/mp4a-latm",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
