"""Streams: log tails and latest values."""
