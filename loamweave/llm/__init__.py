"""Preparation of training data: language, markup, scans, cuts, splitting, packing, mixing, ranking, neighbours."""
