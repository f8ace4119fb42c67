"""Training-data operators (quality, deduplication, mixing, tokenising, sharding).

Nothing outside this package imports it; it imports only general helpers of
``featsift`` (session, exact ranks).
"""
