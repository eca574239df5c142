"""Analytics over large collections of plain-text books, as PySpark DataFrame functions."""
