from .gaps import BUCKET_EDGES, NEW_BUCKET, bucket_labels, gap_bucket, repeat_purchase
from .growth import daily, growth_ratio
from .titles import EVENT_RULES, classify_event, event_priority

__all__ = [
    "BUCKET_EDGES", "NEW_BUCKET", "bucket_labels", "gap_bucket", "repeat_purchase",
    "daily", "growth_ratio", "EVENT_RULES", "classify_event", "event_priority",
]
