"""The registered queries, and for each the same question as SQL for an independent engine."""
