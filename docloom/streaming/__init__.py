"""Structured Streaming variants. The batch operators are the reference behaviour; these are extensions."""
