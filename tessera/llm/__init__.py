"""Operators for training data: clusters, percentiles, containers, mixtures and languages."""
