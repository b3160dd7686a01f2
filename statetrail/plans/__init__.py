"""The queries, one function each."""
