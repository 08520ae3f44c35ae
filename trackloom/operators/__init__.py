"""Operators over detections, tracks, segments, catalogs and feeds."""
