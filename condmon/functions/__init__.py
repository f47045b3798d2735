from condmon.functions.labels import (
    bin_right_open, material, normalise_wear, sample_time, split_label, to_um,
)
from condmon.functions.text import (
    canonical_type, is_rvs, name_matches, normalise_path, parse_param, set_number, to_number, to_ts,
)

__all__ = [
    "bin_right_open", "canonical_type", "is_rvs", "material", "name_matches", "normalise_path",
    "normalise_wear", "parse_param", "sample_time", "set_number", "split_label", "to_number",
    "to_ts", "to_um",
]
