"""The registered queries, by topic."""
