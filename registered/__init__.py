"""The queries the entry file registers, with their SQL."""
