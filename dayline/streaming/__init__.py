"""Fits that follow a stream of observations."""
