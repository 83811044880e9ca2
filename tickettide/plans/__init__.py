"""Reports, SQL views, the snapshot store and the sync job built from operators."""
