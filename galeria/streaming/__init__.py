"""Streams: bursts, latest values, live counts, online clusters."""
