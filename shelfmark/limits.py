"""The answer sizes that the exploration operators take unless told otherwise.

They are defaults: a caller may ask for less, for more, or with ``None`` for the whole answer.
"""

READ_PAGES = 20
GLOB_RESULTS = 500
FIND_RESULTS = 500
LIST_RESULTS = 1000
SCRATCH_LIST_RESULTS = 1000
TREE_ENTRIES = 2000

GREP_FILES = 200
GREP_MATCHES = 100
GREP_MATCHES_PER_FILE = 10
GREP_CONTEXT_LINES = 5
GREP_BYTES = 5_000_000
GREP_LINE_CHARS = 300

OUTLINE_PAGES = 50
OUTLINE_HEADINGS = 300
OUTLINE_TITLE_CHARS = 200

TABLE_PAGES = 50
TABLES = 50
TABLE_ROWS = 200

DIFF_PAGES = READ_PAGES
DIFF_LINES = 500

MAX_PAGE = 9999
PAGE_DIGITS = 4

RECONCILE_GRACE_SECONDS = 900
SCRATCH_TTL_DAYS = 7
SUPERSEDED_DAYS = {"scratch": 1, "derived": 7, "tenants": 30}
ALARM_PERIOD_SECONDS = 300
MAX_DELIVERIES = 5
DEAD_LETTER_DAYS = 14


def size_of(wanted: int | None) -> int | None:
    """A requested size of at least one; ``None`` stays, and asks for everything."""
    return None if wanted is None else max(1, int(wanted))
