import random

import pytest

from chronofold.plans.geometry import duration_windows, row_windows
from chronofold.plans.spec import SizeSpec, TemporalPartitionSpec, TemporalSemanticsSpec, duration_us, validate_partition_spec, validate_step, validate_temporal_semantics

DAY = 86_400_000_000


@pytest.mark.parametrize("value", [True, 0, -3, 0.0, 1.0, 1.5, None, [], "5"])
def test_sizes_that_are_none(value):
    with pytest.raises((TypeError, ValueError)):
        SizeSpec.from_value(value)


def test_durations():
    assert [duration_us(x) for x in ("30D", "12h", "1W", "90min", "P1D")] == [30 * DAY, DAY // 2, 7 * DAY, 90 * 60_000_000, DAY]


def test_specs_that_are_none():
    for bad in (
        {"train_size": "3D", "test_size": 2}, {"train_size": "0D", "test_size": "1D"}, {"train_size": "3D"}, {"layout": "other", "train_size": 3, "test_size": 2},
        {"train_size": 3, "test_size": 2, "calendar_frequency": "D"}, {"train_size": "3D", "test_size": "1D", "calendar_frequency": "ME"}, {"train_size": 3, "test_size": 2, "validation_size": 1},
    ):
        with pytest.raises(ValueError):
            validate_partition_spec(TemporalPartitionSpec(**bad))
    with pytest.raises(ValueError):
        validate_step("0D", "duration")
    with pytest.raises(ValueError):
        validate_temporal_semantics(TemporalSemanticsSpec("t", segment_time_cols={"train": "u"}), "rows")


def brute(sizes, gaps, tail, step, strategy, low, high, partial):
    """The same folds by walking a cursor."""
    out, k = [], 0
    while True:
        start, cursor, b = low + k * step, low + k * step, []
        for i, (size, gap) in enumerate(zip(sizes, gaps)):
            cursor += gap
            if i == 0 and strategy == "expanding":
                a = low + gap
                e = start + size
                if e <= a:
                    e = a + size
            else:
                a, e = cursor, cursor + size
            b.append((a, e))
            cursor = e
        cut = b[-1][1] + tail > high
        if cut:
            if not partial or b[-1][0] >= high:
                return out
            b[-1] = (b[-1][0], high + 1)
        out.append((b, cut))
        if strategy == "single":
            return out
        k += 1


def test_random_duration_folds_equal_a_cursor():
    r = random.Random(4)
    for _ in range(400):
        val = r.random() < 0.4
        sizes = [r.randint(1, 6) for _ in range(2 + val)]
        gaps = [r.choice([0, 0, 1, 2]) for _ in sizes]
        tail, step, high = r.choice([0, 0, 2]), r.randint(1, 4), r.randint(0, 30) * DAY
        names = ["train", "validation", "test"] if val else ["train", "test"]
        spec = TemporalPartitionSpec("train_val_test" if val else "train_test", **{f"{n}_size": f"{s}D" for n, s in zip(names, sizes)}, **{f"gap_before_{n}": f"{g}D" for n, g in zip(names, gaps) if g}, gap_after_test=f"{tail}D" if tail else None)
        strategy, partial = r.choice(["single", "rolling", "expanding"]), r.random() < 0.4
        found = [(list(w.bounds.values()), w.is_partial) for w in duration_windows(validate_partition_spec(spec), step * DAY, strategy, 0, high, partial)]
        assert found == brute([s * DAY for s in sizes], [g * DAY for g in gaps], tail * DAY, step * DAY, strategy, 0, high, partial)


def rows_of(spec, step, strategy, n, partial=False):
    return [[b - a for a, b in w.bounds.values()] for w in row_windows(validate_partition_spec(TemporalPartitionSpec(**spec)), SizeSpec.from_value(step), strategy, n, partial)]


def test_row_folds():
    assert rows_of({"layout": "train_val_test", "train_size": 4, "validation_size": 2, "test_size": 2}, 2, "expanding", 12) == [[4, 2, 2], [6, 2, 2], [8, 2, 2]]
    assert rows_of({"train_size": 5, "test_size": 5}, 5, "rolling", 9, True) == [[5, 4]]
    assert rows_of({"train_size": 0.5, "test_size": 0.2}, 0.2, "rolling", 10) == [[5, 2], [5, 2]]
    with pytest.raises(ValueError):
        rows_of({"train_size": 0.01, "test_size": 0.5}, 0.5, "rolling", 10)
