"""Operators: functions from DataFrame to DataFrame. None of them creates a session."""
