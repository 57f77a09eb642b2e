"""Declared schemas (DDL text) of the input tables."""

FIELD_LOG = (
    "id string, sex string, date date, hr int, month string, season string, "
    "tsurf double, x_ms2 double, y_ms2 double"
)
LAB_READINGS = ("id string, sex string, mean_temp double")
LAB_PAIRS = (
    "lizard string, date string, time string, date_time string, "
    "tsurf_temp double, tsel_temp double, time_of_day string"
)
ENVIRONMENT = (
    "date string, time int, month string, type string, model_id string, value double"
)
MINUTE_ACTIVITY = (
    "id string, sex string, season string, date date, hr int, acc double, tsurf double"
)
CALIBRATION = ("date_time string, tb_dead double, model_temp double")
TRAITS = (
    "id string, male int, female int, history string, sex string, "
    "db double, e double, activity double, topt double, pmax double"
)
