"""Random windows over token shards."""

import numpy as np
import pytest

from textloom.sources import shards

SIZES = {"a": 4000, "b": 1000, "c": 12, "d": 9000, "e": 300}


@pytest.fixture
def folder(tmp_path):
    for i, (name, n) in enumerate(SIZES.items()):
        (10_000 * i + np.arange(n)).astype("<u2").tofile(tmp_path / f"{name}.bin")  # a token tells its shard and place
    return str(tmp_path)


@pytest.mark.parametrize("side", ["train", "val"])
def test_windows(spark, folder, side):
    size, draws, share = 20, 6000, 0.2
    rows = shards.read_windows(spark, folder, size, draws, side=side, fraction=share, seed=3, draws_a_partition=1700).collect()
    assert sorted(r.draw for r in rows) == list(range(draws))
    room = {}
    for name, n in SIZES.items():
        cut = int(n * (1 - share))
        low, high = (0, cut) if side == "train" else (cut, n)
        room[f"{name}.bin"] = (low, max(0, high - low - size))
    total, seen = sum(n for _, n in room.values()), dict.fromkeys(room, 0)
    for r in rows:
        low, n = room[r.shard]
        i = list(SIZES).index(r.shard[0])
        assert low <= r.offset < low + n
        assert r.inputs == ((10_000 * i + r.offset + np.arange(size)) % 65536).tolist() and r.targets == ((10_000 * i + r.offset + 1 + np.arange(size)) % 65536).tolist()
        seen[r.shard] += 1
    for name, (_, n) in room.items():
        p = n / total
        assert abs(seen[name] - draws * p) <= 4 * np.sqrt(draws * p * (1 - p))
    again = shards.read_windows(spark, folder, size, draws, side=side, fraction=share, seed=3, draws_a_partition=1700)
    assert {(r.draw, r.shard, r.offset) for r in again.collect()} == {(r.draw, r.shard, r.offset) for r in rows}
    other = shards.read_windows(spark, folder, size, 50, side=side, fraction=share, seed=4).collect()
    assert {(r.draw, r.offset) for r in other} != {(r.draw, r.offset) for r in rows if r.draw < 50}


def test_windows_need_room(spark, folder):
    with pytest.raises(Exception, match="no shard has room"):
        shards.read_windows(spark, folder, 9_500, 5).count()
    with pytest.raises(Exception, match="no token shards"):
        shards.read_windows(spark, folder + "/none", 5, 5).count()
