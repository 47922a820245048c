"""Row-level column expressions: recodes, parsing, policy text, hashing."""
