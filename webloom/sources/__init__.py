"""Readers and writers: capture manifests, sitemaps, stored API responses, fetch rows, robots files."""
