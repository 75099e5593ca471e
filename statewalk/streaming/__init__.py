"""Part of statewalk: streaming."""
