"""Readers and writers: sales tables, requests, model folders."""
