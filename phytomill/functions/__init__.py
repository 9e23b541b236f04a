"""Part of phytomill: functions."""
