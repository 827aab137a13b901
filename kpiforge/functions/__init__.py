"""Column expressions shared by the operators (scalar functions, no UDFs)."""

from .columns import (  # noqa: F401
    age_years,
    clean_label,
    display_name,
    html_escape,
    lit_date,
    lit_ts,
    null_safe_concat,
    pairs_to_arrays,
    truncate,
)
from .timewin import Calendar  # noqa: F401
