"""Operators: DataFrame to DataFrame, with fit/apply objects where statistics come from training rows.

Every fit brings back one small row per column (or a checked, bounded list) and applies it as
literals, so applying is a projection inside generated code: no join, no second scan.
"""
