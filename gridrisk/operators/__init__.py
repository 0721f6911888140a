"""Panels, model stages and scores, each from DataFrame to DataFrame; the target month is a column, so one plan covers all targets."""
