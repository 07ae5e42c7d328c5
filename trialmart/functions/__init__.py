from trialmart.functions.coerce import (
    flag,
    json_texts,
    loose_bool,
    loose_double,
    loose_int,
    percent,
    ratio,
)

__all__ = ["flag", "json_texts", "loose_bool", "loose_double", "loose_int", "percent", "ratio"]
