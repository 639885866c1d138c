"""Relational operators over observations, scores, lags and spectra."""
