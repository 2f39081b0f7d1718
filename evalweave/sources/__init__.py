"""Readers and writers of data sets, predictions, leaderboards and run history."""
