"""Readers and writers of the tables that enter and leave the library."""
