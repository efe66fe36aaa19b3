"""Context analytics on Spark: corpus build, ranked retrieval, event roll-ups, context assembly."""
