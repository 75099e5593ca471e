"""Part of statewalk: operators."""
