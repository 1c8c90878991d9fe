"""Readers, writers and driver-table stand-ins (S*)."""
