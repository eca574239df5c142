"""Patterns, word lists and limits that define the results.

The patterns use Java regex syntax, which Spark evaluates as it stands.
"""

# --- fixed values: header fields ---------------------------------------------------------
FILE_NAME = r"([^/]+\.txt)$"
TITLE = r"(?im)^Title:\s*(.+)$"
RELEASE_DATE = r"(?im)^Release Date:\s*(.+)$"
LANGUAGE = r"(?im)^Language:\s*(.+)$"
ENCODING = r"(?im)^Character set encoding:\s*(.+)$"
YEAR = r"(\d{4})"

# --- fixed values: author lines, tried in this order -------------------------------------
AUTHOR_LABEL = r"(?im)^\s*Author(?:s)?\s*:\s*(.+?)\s*$"
AUTHOR_BY = (
    r"(?im)^\s*by\s+([A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){0,7})\s*(?:,|\r?$)"
)
AUTHOR_BY_ALONE = r"(?im)^\s*By\s+([A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){0,7})\s*$"

# The same, as they are searched for. Blank lines before an author's line are not part of the
# name, and ``^\s*`` starts over them from each line of a blank run, which is quadratic. A match
# that stays in the line of its first letter has the same group, and there is one wherever there
# is the other: what stands between the last line end of the blanks and the letter is blank.
_INDENT = r"[ \t\x0B\f]*"
SEARCHED_LABEL = AUTHOR_LABEL.replace(r"^\s*", "^" + _INDENT, 1)
SEARCHED_BY = AUTHOR_BY.replace(r"^\s*", "^" + _INDENT, 1)

# --- fixed values: accepted languages and rejected authors -------------------------------
LANGUAGES = (
    "English", "Latin", "French", "German", "Spanish",
    "Italian", "Portuguese", "Dutch", "Greek", "Hebrew",
)
NOT_AUTHORS = ("project gutenberg", "the mount horeb.", "unknown")

# --- fixed values: body markers, matched on lower-cased text ------------------------------
BODY_START = r"(?s)^.*?\*\*\* start of this project gutenberg ebook.*?\*\*\*"
BODY_END = r"(?s)\*\*\* end of this project gutenberg ebook.*$"

# --- fixed values: limits ------------------------------------------------------------------
VOCABULARY_SIZE = 10_000
MIN_BOOKS_PER_TERM = 2
INFLUENCE_YEARS = 5
TOP_SIMILAR = 5

# --- fixed values: MLlib's default English stop words --------------------------------------
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom
    this that these those am is are was were be been being have has had having do does did
    doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some
    such no nor not only own same so than too very s t can will just don should now i'll you'll
    he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
    they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
    doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
    how's let's ought that's there's what's when's where's who's why's would
    """.split()
)
