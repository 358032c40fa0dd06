"""Readers and writers of labelled transactions."""
