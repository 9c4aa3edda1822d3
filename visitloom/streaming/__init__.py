"""Streams: tailing logs, folding events, merging late facts."""
