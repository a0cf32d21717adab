"""Streams: the reductions of batches (row_id, idx, val), kept up to date as rows come."""
