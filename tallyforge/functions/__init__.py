"""Column functions: rounding, time, predicates, text."""

from .numbers import (
    clamp, convert_units, health_score, max_abs, pct, pg_int, range_abs, rnd, row_mean, within_bounds, validate_bounds,
)
from .labels import (
    CATEGORY_ACTION, CATEGORY_OWNER, capability_class, category_owner, classify_severity, confidence_label,
    elapsed_text, freshness, normalize_oid_array,
    normalize_oid, owner_action, quality_impact, safe_key,
)
from .predicates import (
    SPEC_LIMITS, in_or_all, is_distinct, last, last_of_data, scope_devices, spec_flag_columns, spec_flags, time_range,
)
from .timeutil import date_bin, epoch_seconds, interval_us, minus, seconds_between, time_bucket, ts_lit, ts_plus

__all__ = [n for n in dir() if not n.startswith("_")]
