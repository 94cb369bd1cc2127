"""The registered queries: one per operator, each with SQL that computes the same."""
