"""Writers: whole books from their tables, and reports."""
