"""Timetable and journey analytics on Spark."""
