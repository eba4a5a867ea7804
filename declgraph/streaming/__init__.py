"""The change feed: files and unsaved overlays as an upsert stream, and a parse cache that only sees what changed."""
