"""Whole jobs: training table, evaluation, scoring; and the tables derived from conversations that exercise them."""
