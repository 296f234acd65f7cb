"""Jobs that go on where they stopped, PNG files, deep answers."""

import json
import struct
import threading
import time
import zlib

import numpy as np
import pytest

from ruleloom.functions import detectors, images, salvage


def jobs(spark, n=12):
    return spark.createDataFrame([(f"k{i}", json.dumps({"n": i}) if i else None) for i in range(n)] + [("k3", json.dumps({"n": 3}))], "key string, request string")


def test_jobs_are_called_once_and_failures_again(spark, tmp_path):
    log = tmp_path / "log"

    def call(request, good=True):
        with log.open("a") as f:
            f.write(request + "\n")
        if json.loads(request)["n"] == 5 and not good:
            raise ConnectionError("lost")
        return f"answer {json.loads(request)['n']}"

    first = {r["key"]: (r["raw"], r["failure"]) for r in detectors.run_jobs(jobs(spark), "key", "request", lambda r: call(r, False), f"{tmp_path}/raw", waves=3).collect()}
    assert first["k5"] == (None, "lost") and first["k0"] == (None, "no request") and first["k3"] == ("answer 3", None) and len(first) == 12
    assert len(log.read_text().splitlines()) == 11
    second = {r["key"]: (r["raw"], r["failure"]) for r in detectors.run_jobs(jobs(spark), "key", "request", call, f"{tmp_path}/raw", waves=3).collect()}
    assert second["k5"] == ("answer 5", None) and {k: v for k, v in second.items() if k != "k5"} == {k: v for k, v in first.items() if k != "k5"}
    assert log.read_text().splitlines()[11:] == ['{"n": 5}']  # nothing else is called again


def test_jobs_keep_the_rate_and_run_side_by_side(spark, tmp_path):
    log = tmp_path / "log"

    def call(request):
        with log.open("a") as f:
            f.write(f"{time.time()} {threading.get_ident()}\n")
        time.sleep(0.3)
        return "done"

    detectors.run_jobs(jobs(spark, 10), "key", "request", call, f"{tmp_path}/raw", tasks=1, concurrency=4, per_second=10).count()
    rows = sorted(log.read_text().splitlines())
    times = [float(x.split()[0]) for x in rows]
    assert min(b - a for a, b in zip(times, times[1:], strict=False)) > 0.07 and len({x.split()[1] for x in rows}) > 1


def test_png_round_trips():
    rng = np.random.default_rng(1)
    p = rng.integers(0, 256, (7, 5, 4)).astype(np.uint8)
    for kind in (0, 1, 2):
        for level in (0, 9):
            assert (images.decode(images.encode(p, kind, level)) == p).all()


def png(lines, width, height, depth, colour, *more):
    chunk = lambda name, x: struct.pack(">I", len(x)) + name + x + struct.pack(">I", zlib.crc32(name + x))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + b"".join(chunk(*m) for m in more) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_filters_and_colour_types():
    # average and Paeth lines of a grey image, worked out by hand
    got = images.decode(png(bytes([0, 10, 20, 30, 3, 5, 5, 5, 4, 1, 1, 1]), 3, 3, 8, 0))[..., 0]
    assert got.tolist() == [[10, 20, 30], [10, 20, 30], [11, 21, 31]]
    assert images.decode(png(bytes([0, 0b10100000]), 3, 1, 1, 0))[0, :, 0].tolist() == [255, 0, 255]
    assert images.decode(png(bytes([0, 1, 0]), 2, 1, 8, 3, (b"PLTE", bytes([1, 2, 3, 9, 8, 7])), (b"tRNS", bytes([0]))))[0].tolist() == [[9, 8, 7, 255], [1, 2, 3, 0]]
    assert images.decode(png(bytes([0, 18, 52]), 1, 1, 16, 0))[0, 0].tolist() == [18, 18, 18, 255]
    assert images.decode(png(bytes([0, 5, 9]), 1, 1, 8, 4))[0, 0].tolist() == [5, 5, 5, 9]


def test_what_is_no_png(spark):
    good = images.encode(np.zeros((2, 2, 4), np.uint8))
    bad = [None, b"", b"GIF89a", good[:-20], good[:40] + b"x" + good[41:], png(b"\x00\x00", 9, 9, 8, 0), png(b"\x07\x00", 1, 1, 8, 0), png(b"", 1 << 20, 1 << 20, 8, 0)]
    rows = images.pixel_hashes(spark.createDataFrame([(i, b) for i, b in enumerate([*bad, good])], "id long, png binary"), "id", "png").collect()
    assert {r["id"] for r in rows if r["pixels"] is not None} == {len(bad)}


def test_images_above_the_bound_shrink():
    p = np.random.default_rng(2).integers(0, 256, (64, 64, 4)).astype(np.uint8)
    whole = images.encode(p)
    assert images.bounded(whole, len(whole)) == whole
    small = images.bounded(whole, len(whole) // 3)
    assert len(small) <= len(whole) // 3 and images.decode(small).shape == (32, 32, 4)
    with pytest.raises(ValueError, match="fit"):
        images.bounded(whole, 10)


def test_answers_nested_too_deeply_hold_no_object():
    deep = '{"a":' * 100_000 + "1" + "}" * 100_000
    assert salvage.first_fenced(deep) is None and salvage.greedy(deep) is None
    assert salvage.last_object('{"n": 1} then {"b": {"c": 2}} and {"cut": ') == {"b": {"c": 2}}
    assert salvage.last_object("x " + "{" * 2_000 + ' {"a": 1}') == {"a": 1}
