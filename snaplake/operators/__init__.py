"""DataFrame operators: queries, diffs, checks, filters, aggregates, search, sessions, sync."""
