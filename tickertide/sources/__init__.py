"""Readers and writers: headlines, feeds, prices, keyword configuration, score table."""
