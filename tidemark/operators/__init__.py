"""DataFrame operators: joins, aggregates, intervals, top-k, deduplication, selection, checks."""
