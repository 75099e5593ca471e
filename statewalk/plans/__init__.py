"""Part of statewalk: plans."""
