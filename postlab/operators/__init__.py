"""DataFrame-level operators: lookups, term statistics, vectors, neighbours, folds, evaluation."""
