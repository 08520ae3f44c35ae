"""Queries of the operators over the driver's tables.

The tables play roles: events are frames (user_id a video, ts the time in hours since
2024, value a measure, event_type a signal), customer profiles, orders highlights,
lineitem comments and poll options, part library items, pages paths.  An hour stands
for a second of the default parameters.
"""
