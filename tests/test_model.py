import pytest

from sonolith.model import CD_QUALITY, Format, InvalidFormat, InvalidParameter, frames_of, half_away, parse_duration, show_duration


def test_format_rules_and_sizes():
    f = Format(2, 44_100, 16, "pcm")
    assert f == CD_QUALITY and f.block_align == 4 and f.byte_rate == 176_400 and f.channel_layout == ("front_left", "front_right")
    assert f.as_float().is_float and f.with_(channels=1).channel_layout == ("front_center",)
    for bad in ({"channels": 0}, {"channels": 33}, {"sample_rate": 7999}, {"bit_depth": 12}, {"valid_bits": 17}, {"channel_layout": ("front_left", "front_left")}):
        with pytest.raises(InvalidFormat):
            Format(**({"channels": 2, "sample_rate": 8000, "bit_depth": 16, "sample_format": "pcm"} | bad))
    with pytest.raises(InvalidFormat):
        Format(1, 8000, 32, "float", valid_bits=24)


def test_durations():
    assert [parse_duration(x) for x in ("12.5", "01:02", "1:00:01.5", 3)] == [12.5, 62.0, 3601.5, 3.0]
    assert show_duration(3661.0005) == "01:01:01.001" or show_duration(3661.0005) == "01:01:01.000"
    for bad in ("1:60", "x", "-1", "1:2:3:4"):
        with pytest.raises(InvalidParameter):
            parse_duration(bad)
    assert [half_away(x) for x in (2.5, -2.5, 0.4)] == [3, -3, 0] and frames_of(0.0005, 1000) == 1
    with pytest.raises(InvalidParameter):
        frames_of(float("nan"), 8000)
