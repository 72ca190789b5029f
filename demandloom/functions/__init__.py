from demandloom.functions.expr import (  # noqa: F401
    as_double,
    is_empty,
    is_json_container,
    money_text,
    name_col,
    null_if_nan,
    percent_text,
    round_half_even,
    strip,
    to_number,
    truncate,
)
from demandloom.functions.quantiles import exact_quantiles  # noqa: F401
