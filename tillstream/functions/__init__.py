"""Column functions."""

from tillstream.functions.columns import POINTS_PER_UNIT, earned_points, json_text, parsed_json

__all__ = ["POINTS_PER_UNIT", "earned_points", "json_text", "parsed_json"]
