"""Readers and writers of the tables that jobs work on."""
