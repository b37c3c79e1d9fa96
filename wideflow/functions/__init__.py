"""Column-level helpers shared by the operators (JVM-side expressions only)."""

from wideflow.functions.expr import (  # noqa: F401
    all_sum, md5_order_key, hex_bucket, ratio, nan_to_null, numeric_fields,
    require_columns, THRESHOLD_INDEX_MAX,
)
from wideflow.functions.ranking import (  # noqa: F401
    ranked_within, ordered_scan, range_buckets,
)
