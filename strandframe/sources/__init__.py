"""Readers of sequence-analysis text formats."""
