"""Canonical table layouts. Times are epoch milliseconds unless a column is a timestamp."""

MANIFEST = (
    "vault string, device string, kind string, path string, path_hash string, "
    "content_hash string, mtime long, ctime long, size long"
)
BASE_STATE = "vault string, device string, path string, hash string, mtime long, size long"
SERVER_STATE = (
    "vault string, kind string, path string, content_hash string, mtime long, ctime long, "
    "size long, is_deleted boolean, last_time long"
)
CHANGE_EVENTS = (
    "event_id long, ts timestamp, vault string, device string, op string, path string, "
    "old_path string, content_hash string, mtime long, size long"
)
LOG_EVENTS = (
    "seq long, id string, ts long, type string, action string, path string, status string, "
    "progress int, message string, vault string"
)
MESSAGES = "seq long, ts long, direction string, raw string"

STATE_KEY = ["vault", "device", "path"]
ITEM_KEY = ["vault", "path"]
