"""Incremental maintenance of predictions and leaderboard."""
