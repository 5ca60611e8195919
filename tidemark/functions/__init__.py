"""Column helpers: frames, guarded rolling aggregates, missing-value rules, tail probabilities."""
