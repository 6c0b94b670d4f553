import random

import pytest

from flowloom.sources import readers, tail
from flowloom.streaming.enrich import run_to_table


def whole_lines(raw: bytes):
    place, out = 0, []
    *lines, _ = raw.split(b"\n")
    for line in lines:
        out.append((place, line))
        place += len(line) + 1
    return out


@pytest.mark.parametrize("read", [3, 1 << 20])
def test_any_cut_gives_the_same_lines(tmp_path, monkeypatch, read):
    monkeypatch.setattr(tail, "READ_BYTES", read)
    rng = random.Random(2)
    raw = b"".join(rng.choice([b"", b"a", b"longer line", "漢字".encode()]) + b"\n" for _ in range(60)) + b"unfinished"
    (tmp_path / "f").write_bytes(raw)
    store, base = tail.open_folder(str(tmp_path))
    for size in (1, 2, 7, 50, 5000):
        with store.open_input_file(f"{base}/f") as file:
            cut = tail.ranges({}, {"f": len(raw)}, size)
            found = [row for r in cut for row in tail.lines_ending_in(file, r.begin, r.end)]
        assert found == whole_lines(raw)


def test_offsets_only_grow():
    cut = tail.ranges({"a": 5}, {"a": 12, "b": 3}, 4)
    assert [(r.file, r.begin, r.end) for r in cut] == [("a", 5, 9), ("a", 9, 12), ("b", 0, 3)]
    assert tail.ranges({"a": 5}, {"a": 5}) == []
    with pytest.raises(ValueError, match="shrank"):
        tail.ranges({"a": 5}, {"a": 4})


def test_files_that_appear_grow_and_hold_half_a_line(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def drain():
        rows = run_to_table(readers.stream_polled(spark, str(folder), rangeBytes="11"), str(tmp_path / "out"))
        return sorted((r.pid, r.feature, r.ts_ns, r.value) for r in rows.collect())

    one, two = folder / "vmrss_bytes_pid7.csv", folder / "utime_pid8.csv"
    one.write_bytes(b"ts_ns,value\r\n1,2\r\n2,3.5\nbad,row\n3,")
    (folder / "memavailable_bytes.csv").write_bytes(b"ts_ns,value\n1,1\n")
    assert drain() == [("7", "vmrss_bytes", 1, 2.0), ("7", "vmrss_bytes", 2, 3.5)]
    with one.open("ab") as file:
        file.write(b"44\n")
    two.write_bytes(b'value,note,"ts_ns"\n9,x,5\n')
    (folder / "free_pid9.csv").write_bytes(b"time,reading\n1,2\n")
    grown = [("7", "vmrss_bytes", 1, 2.0), ("7", "vmrss_bytes", 2, 3.5), ("7", "vmrss_bytes", 3, 44.0), ("8", "utime", 5, 9.0)]
    assert drain() == grown
    assert drain() == grown
    batch = readers.read_polled(spark, str(folder))
    assert sorted((r.pid, r.feature, r.ts_ns, r.value) for r in batch.collect()) == grown


def test_event_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "sendmsg_pid7.csv").write_bytes(b"1,2\nnoise\n 3 , 4.5 ,x\n5\n")
    rows = run_to_table(readers.stream_events(spark, str(folder)), str(tmp_path / "out")).collect()
    assert sorted((r.pid, r.kind, r.feature, r.ts_ns, r.value) for r in rows) == [
        ("7", "event", "sendmsg", 1, 2.0),
        ("7", "event", "sendmsg", 3, 4.5),
    ]
