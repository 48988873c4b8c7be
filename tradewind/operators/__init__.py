"""DataFrame in, DataFrame out: joins, ranking, checks, summaries, search."""
