from ectolog.functions.columns import (  # noqa: F401
    MODEL_TO_CARCASS,
    SEASONS,
    SKIN_TO_BODY,
    active_flag,
    calibrate_linear,
    clamp_min,
    code_list,
    date_of,
    effectiveness_index,
    error_band,
    hour_of,
    in_range_flag,
    level_rank,
    mean_se_text,
    month_name,
    movement_vector,
    p_label,
    parse_date,
    parse_ts,
    relabel,
    rescale,
    round_half_even,
    season_of,
    setpoint_deviation,
    signif,
    strict,
)
