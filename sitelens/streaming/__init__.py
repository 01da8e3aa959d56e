"""Structured Streaming forms of latest values, repeated requests and states."""
