"""The line source against Python's own reading of files, and the capped scan's reads."""

import gzip
import json
import random

import pytest

from millrace.sources import lines as L
from millrace.sources import tables as S


def written_files(folder, sizes, seed=1):
    """Files of lines of all lengths, with blank ones, \\r\\n, many bytes a letter, and no line end at the end of some."""
    rng = random.Random(seed)
    want = []
    for f, n in enumerate(sizes):
        rows = [rng.choice(["", "x", "é" * rng.randrange(40), "y" * rng.randrange(300), "  z", f"{f}-{i}"]) for i in range(n)]
        ends = [rng.choice([b"\n", b"\n", b"\r\n"]) for _ in rows]
        if ends and f % 2:
            rows[-1], ends[-1] = "last", b""
        (folder / f"part-{f}.txt").write_bytes(b"".join(r.encode() + e for r, e in zip(rows, ends, strict=True)))
        want += [(f, r) for r in rows]
    return want


@pytest.mark.parametrize("size", [1, 7, 100, 1000, 1 << 20])
def test_every_line_is_in_one_range(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 16)
    want = written_files(tmp_path, [30, 0, 1, 12] if size < 100 else [200, 0, 1, 77])
    files = L.files_of(spark, str(tmp_path))
    ranges, _ = L.ranges_from(files, (0, 0), size, 1 << 62)
    got = [(r[0], x.decode()) for r in ranges for _, x in L.lines_of_range(L.Range(*r))]
    assert [x for _, x in got] == [x for _, x in want] and [f for f, _ in got] == [f for f, _ in want]
    if size >= 100:
        rows = L.read_lines(spark, str(tmp_path), size).orderBy("file", "offset").collect()
        assert [(r.file, r.value) for r in rows] == want


def test_a_capped_scan_stops_reading(spark, tmp_path):
    for f in range(8):
        rows = [json.dumps({"i": f * 5000 + i, "pad": "p" * 100}) for i in range(5000)]
        rows[::50] = [""] * 100  # one in fifty is blank or broken
        rows[1::50] = ["{"] * 100
        (tmp_path / f"{f}.jsonl").write_text("\n".join(rows) + "\n")
    all_bytes = sum(p.stat().st_size for p in tmp_path.iterdir())
    good = [f * 5000 + i for f in range(8) for i in range(5000) if i % 50 > 1]
    for limit in (1, 10, 479, 480, 481, 3000, 9000, 38_400, 10**9):
        got = L.read_capped(spark, str(tmp_path / "*.jsonl"), limit, S.PARSES)
        values = [json.loads(r.value)["i"] for r in got.lines.orderBy("file", "offset").collect()]
        assert values == good[:limit] and got.kept == len(values)
        assert got.lines_read <= 1.2 * len(values) + 1200 and got.bytes_read <= min(all_bytes, len(values) * 145 + 3 * L.FIRST)
    found = S.read_tolerant(spark, str(tmp_path), "i int", limit=4801).orderBy("_order").collect()
    assert [r.i for r in found] == good[:4801] and found[-1].i == 5002


def test_capped_scans_of_little(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("")
    assert L.read_capped(spark, str(tmp_path), 5).lines.count() == 0
    assert L.read_capped(spark, str(tmp_path / "none*"), 5).kept == 0
    (tmp_path / "b.jsonl").write_text('{"i": 1}\n{"i": 2}')
    assert L.read_capped(spark, str(tmp_path), 0).lines_read == 0
    assert L.read_capped(spark, str(tmp_path), 5, "value like '%9%'").kept == 0
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write("".join(f'{{"i": {i}}}\n' for i in range(3, 3000)))
    assert [r.i for r in S.read_tolerant(spark, str(tmp_path), "i int", limit=50).orderBy("_order").collect()] == list(range(1, 51))


def test_a_line_longer_than_any_range(spark, tmp_path):
    (tmp_path / "a.txt").write_text("short\n" + "long" * 100_000 + "\nend\n")
    rows = L.read_lines(spark, str(tmp_path / "a.txt"), 1000).orderBy("offset").collect()
    assert [len(r.value) for r in rows] == [5, 400_000, 3]
