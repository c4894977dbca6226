"""Structured Streaming jobs: watermarked rollups, keyed state, foreachBatch writers."""
