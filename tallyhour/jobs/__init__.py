"""Programs for ``spark-submit``; connector packages are given there."""
