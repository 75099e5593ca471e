"""Part of statewalk: sources."""
