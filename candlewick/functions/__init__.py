"""Column-expression helpers: time grid (bucketing, calendar) and scalar clean-ups."""

from candlewick.functions.scalars import (  # noqa: F401
    avg_price, coerce_double, epoch_to_time, filter_field, has_permission, strip_zeros,
)
from candlewick.functions.timegrid import (  # noqa: F401
    batch_time, bucket_start, latest_complete_period, minutes_of, next_boundary,
    parse_interval, period_cutoff, period_label, period_start,
)
