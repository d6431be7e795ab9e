"""The checked queries: how each runs on the given tables, and the SQL it must agree with."""
