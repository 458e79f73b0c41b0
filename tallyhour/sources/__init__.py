"""Where rows come from: topics, dimensions, raw tables."""
