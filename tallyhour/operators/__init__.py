"""DataFrame to DataFrame steps, shared by batch jobs and micro-batches."""
