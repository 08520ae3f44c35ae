"""A PySpark engine for detections, tracks, segments, catalogs and feeds."""
