"""Operators: profile, correlation, ordering, splits, evaluation, transforms,
resampling, models, importance, dashboard data."""
