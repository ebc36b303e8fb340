"""Thresholds, patterns, formats and texts that results depend on.

They define the reports, so they are stated here once and in plain form.
"""

from __future__ import annotations

import datetime as dt

# --- Fixed values: message filter -------------------------------------------------
MIN_MESSAGE_LENGTH = 15
LINK_TOKEN = "http"
# "." must stop at a line feed only, which Java's own "." does not do.
EMOJI_PATTERN = r"<:[^\n]*?:[a-z,A-Z,0-9]*?>"
TAG_PATTERN = r"<@[^\n]*?>"
# Every character that is not white space (Python's str.isspace set).
NON_BLANK_PATTERN = (
    r"[^\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
QUALITY_MIN_REACTIONS = 4

# --- Fixed values: names ----------------------------------------------------------
# Emoticons, symbols, transport, flags, dingbats, and the wide last range.
USERNAME_STRIP_PATTERN = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
    r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
)
NON_ASCII_PATTERN = r"[^\x00-\x7F]"
NAMELESS_PREFIX = "User "

# --- Fixed values: replies --------------------------------------------------------
DELETED_AUTHOR = "Deleted User"
DELETED_CONTENT = "Message was deleted"
UNKNOWN_AUTHOR = "Unknown User"
MISSING_CONTENT = "Content unavailable"

# --- Fixed values: reports --------------------------------------------------------
ACTIVE_MIN_MESSAGES = 30
LEADERBOARD_SIZE = 10
PERSONAL_MONTHS = 12
PERSONAL_STEP_DAYS = 30
INFLATION_MONTHS = 12
VOLUME_MONTHS = 24
TRADE_PARTNERS = 5
TRADE_WINDOW_DAYS = 365
MOST_LIKED_SIZE = 5
EDGE_WEIGHT_SCALE = 50
EDGE_QUANTILE = 0.80
CENTRALITY_MAX_ITER = 100
CENTRALITY_TOLERANCE = 1e-6
CLUSTERS = 4
CLUSTER_ROUNDS = 300
MATRIX_MIN_FIGURE = 24.0
MATRIX_FIGURE_PER_USER = 0.6
STATUS_SURPLUS = "SURPLUS"
STATUS_DEFICIT = "DEFICIT"
STATUS_NEUTRAL = "NEUTRAL"

# --- Fixed values: report options -------------------------------------------------
FLAG_LEADERBOARD = "--leaderboard"
FLAG_LEAST = "--least"
FLAG_ALL = "--all"

# --- Fixed values: ingest ---------------------------------------------------------
SCAN_START = dt.datetime(2017, 1, 1, tzinfo=dt.timezone.utc)
REPOPULATE_START = dt.datetime(2023, 1, 1, tzinfo=dt.timezone.utc)
SETTLING_DELAY = "1 day"
USERNAME_REFRESH_SECONDS = 86_400
OFFSET_KEY_PREFIX = "last_scanned_timestamp_"

# --- Fixed values: text cells -----------------------------------------------------
NAME_WIDTH = 20
MONTH_LONG = "MMMM yyyy"
MONTH_SHORT = "MMM yyyy"
