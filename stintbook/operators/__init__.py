"""DataFrame operators: interval merging, overlap joins, rankings, line-ups, lookups."""
