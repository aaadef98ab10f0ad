"""Connected components and lookups of hot keys, as the core has them."""

from ..operators.connect import HOT_SHARE, components, lookup

__all__ = ["HOT_SHARE", "components", "lookup"]
