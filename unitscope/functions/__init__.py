"""Column functions."""

from unitscope.functions.text import (
    class_name,
    display_name,
    drop_empty,
    is_whole_number,
    label_map,
    location_name,
    typed_double,
    typed_long,
)

__all__ = [
    "class_name",
    "display_name",
    "drop_empty",
    "is_whole_number",
    "label_map",
    "location_name",
    "typed_double",
    "typed_long",
]
