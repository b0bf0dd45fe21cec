"""Training-data operators: quality, dedup, packing, token counting, sharding.

Nothing outside this subpackage imports it; deleting the folder leaves the
raster engine intact.
"""
