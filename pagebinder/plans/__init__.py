"""The registered queries, by area."""
