"""Operators of a training-data pipeline: counting, sharding, decontamination, scoring, de-duplication, formatting, mixing."""
