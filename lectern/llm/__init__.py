"""Operators of a training-data pipeline: scoring, language, quality, privacy, licences, copies, output."""
