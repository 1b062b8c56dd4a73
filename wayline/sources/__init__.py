"""Readers: delimited timetable files, JSON feeds, encoded texts. All are plans over Spark's own readers."""
