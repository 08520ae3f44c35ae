"""Streaming twins of batch operators; they run the same kernels."""
