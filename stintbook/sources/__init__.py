"""Readers and writers: roster feed, versioned snapshots, stored pages."""
