"""Estimators, model selection, evaluation and the registered queries."""
