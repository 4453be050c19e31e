"""Analytics over append-only conversation and event archives, as Spark jobs."""
