"""Runs over folds: models, systems, studies, bands, online replay, campaigns."""
