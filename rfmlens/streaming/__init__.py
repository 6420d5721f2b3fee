"""Streaming entry points: files that arrive in a folder are scored the way
the batch upload path scores one file (M17)."""

from rfmlens.streaming.file_scoring import score_arriving_files

__all__ = ["score_arriving_files"]
