"""Fixed pipelines: profiling, preparation, feature engineering, training and prediction."""
