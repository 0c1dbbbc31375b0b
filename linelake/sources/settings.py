"""Parameters of line detection and matching, with their ranges."""

from __future__ import annotations

from dataclasses import dataclass, fields


def _in(default: float, low: float, high: float):
    from dataclasses import field

    return field(default=default, metadata={"low": low, "high": high})


@dataclass(frozen=True)
class LineSettings:
    """Values outside their range are refused."""

    rectangle_offset: float = _in(0.5, 0, 10)
    max_rect_size: float = _in(5.0, 1, 50)
    max_relative_rect_size: float = _in(0.5, 0, 1)
    max_plane_error: float = _in(0.005, 0, 1)
    min_inliers: int = _in(10, 0, 1000)
    ransac_rounds: int = _in(300, 1, 10_000)
    min_length: float = _in(0.15, 0, 10)
    max_rating: float = _in(1e6, 0, 1e9)
    max_manhattan: float = _in(64.0, 0, 1e6)
    max_squared_euclidean: float = _in(100.0, 0, 1e6)
    match_ratio: float = _in(0.8, 0, 1)
    max_dist_between_planes: float = _in(0.3, 0, 2)
    min_points_in_rect: int = _in(20, 0, 30)
    min_points_in_prolonged_rect: int = _in(20, 0, 30)
    max_points_for_empty_rect: int = _in(10, 0, 100)
    ransac_stop: float = _in(0.8, 0, 1)
    min_inlier_share: float = _in(0.1, 0, 1)
    max_inlier_gap: float = _in(0.05, 0, 10)
    min_points_in_line: int = _in(10, 1, 100)
    extension_length: float = _in(0.08, 0, 0.5)
    max_deviation: float = _in(0.02, 0, 0.3)
    canny_low: int = _in(50, 1, 200)
    canny_high: int = _in(200, 1, 500)
    hough_threshold: int = _in(10, 1, 200)
    hough_min_length: float = _in(10, 1, 200)
    hough_max_gap: float = _in(10, 1, 200)
    number_of_clusters: int = _in(5, 1, 20)

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if not f.metadata["low"] <= v <= f.metadata["high"]:
                raise ValueError(f"{f.name} = {v} is not in [{f.metadata['low']}, {f.metadata['high']}]")


def read_settings(text: str) -> dict[str, str | int]:
    """`name value` lines; whole numbers as int; '#' begins a comment; the last of a name counts."""
    out: dict[str, str | int] = {}
    for line in text.splitlines():
        parts = line.split("#")[0].split(None, 1)
        if len(parts) == 2:
            value = parts[1].strip()
            out[parts[0]] = int(value) if value.lstrip("-").isdigit() else value
    return out
