"""The registered queries; importing this module fills the registry."""

from framelake.plans import canvas_queries, image_queries, metric_queries, more_queries, order_queries, stream_queries, tile_queries  # noqa: F401
from framelake.plans.registry import QUERIES, SQL  # noqa: F401
