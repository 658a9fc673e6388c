"""Structured Streaming forms of the notification wait, index sync and message classification."""
