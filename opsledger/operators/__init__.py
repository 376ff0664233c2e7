"""Operators: functions of DataFrames that give DataFrames; the clock and all limits are parameters."""
