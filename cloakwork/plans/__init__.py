"""Whole jobs: scan what is unscanned, process files, batch hand-over, reports."""
