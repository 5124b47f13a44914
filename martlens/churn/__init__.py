"""Customer-churn pipeline: features, split, forest, evaluation, risk bands."""
