"""User-level queries, built from the operators."""
