"""Reading books, lines and counts, writing books and counts, and staging intermediate tables."""

from .books import read_books, read_counts, read_lines
from .sinks import write_books, write_counts
from .staging import new_path, stage, staging_scope

__all__ = [
    "new_path",
    "read_books",
    "read_counts",
    "read_lines",
    "stage",
    "staging_scope",
    "write_books",
    "write_counts",
]
