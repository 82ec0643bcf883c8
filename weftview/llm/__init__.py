"""Operators for preparing training data at scale; nothing outside this folder imports it."""
