"""DataFrame operators: history, features, splits, records, plans, models, evaluation."""
