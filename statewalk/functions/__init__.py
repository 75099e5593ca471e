"""Part of statewalk: functions."""
