"""Latency grading of sample streams."""

from subdrift.streaming.grading import grade_new_files, samples_from_files

__all__ = ["grade_new_files", "samples_from_files"]
