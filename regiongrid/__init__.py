"""Region analytics on coordinates, and the operators that prepare language-model training data.

The names below are those of ``api``, which is loaded when one of them is first used.
"""

__version__ = "0.2.0"
__all__ = [
    "Region", "RegionTool", "ReverseResult", "bd09_to_gcj02", "bd09_to_wgs84", "distance", "gcj02_to_bd09", "gcj02_to_wgs84",
    "get_administrative_tree", "get_region", "is_in_china", "is_in_region", "list_regions", "lookup_adcode", "reverse",
    "reverse_batch", "search", "use", "wgs84_to_bd09", "wgs84_to_gcj02",
]


def __getattr__(name: str):
    if name not in __all__:
        raise AttributeError(name)
    from . import api

    return getattr(api, name)
