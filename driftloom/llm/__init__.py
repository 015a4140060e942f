"""Operators for event sequences and texts that feed training corpora."""
