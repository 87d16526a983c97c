"""DataFrame operators: matching, scoring, daily features, returns and statistics."""
