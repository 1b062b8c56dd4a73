"""wayline: timetable, place and text analytics as PySpark DataFrame operators."""
