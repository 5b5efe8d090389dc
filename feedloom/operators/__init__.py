"""Operators on tasks, workers, schedules, records and their versions."""
