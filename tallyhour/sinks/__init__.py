"""Where rows go: topics, batch-tagged tables, JDBC targets, the scan cursor."""
