"""Compositions of operators: policy, model, holdout and search."""
