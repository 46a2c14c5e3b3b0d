"""Readers: files of several kinds as tables. Parsing of packed formats uses the standard library within Arrow batches."""
