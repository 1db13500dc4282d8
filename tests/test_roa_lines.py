import random

import numpy as np
import pytest

from netledger.sources import roa_lines as rl

GOOD = "rsync://h/a.roa,AS64500,192.0.2.0/24,24,2023-01-01 00:00:00,2024-01-01 00:00:00"


def reasons(*lines, chunk=rl.CHUNK):
    return [r[1] for r in rl.parse_batch(list(range(len(lines))), list(lines), chunk)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 128])
def test_reasons(chunk):
    cases = {
        GOOD: None,
        '"a ""b"", c",1,10.0.0.0/8,,x,y': None,
        ' u , as1.5 , 10.0.0.0/8 , None , , ': None,
        '"u"x,1,10.0.0.0/8,,a,b': "quoting",
        'u"x,1,10.0.0.0/8,,a,b': "quoting",
        ' "u",1,10.0.0.0/8,,a,b': "quoting",
        '"u,1,10.0.0.0/8,,a,b': "quoting",
        'u,1,10.0.0.0/8,,a,"': "quoting",
        'u,1,10.0.0.0/8,,a,""': None,
        "u,1,10.0.0.0/8,,a": "column_count",
        "u,1,10.0.0.0/8,,a,b,": "column_count",
        "u,AS,10.0.0.0/8,,a,b": "origin",
        "u,4294967296,10.0.0.0/8,,a,b": "origin",
        "u,4294967295,10.0.0.0/8,,a,b": None,
        "u,1.65536,10.0.0.0/8,,a,b": "origin",
        "u,AS 1,10.0.0.0/8,,a,b": "origin",
        "u,٣,10.0.0.0/8,,a,b": "origin",
        "u,1,10.0.0.1/8,,a,b": "prefix",
        "u,1,010.0.0.0/8,,a,b": "prefix",
        "u,1,10.0.0.0/33,,a,b": "prefix",
        "u,1,fd00::/8,129,a,b": "max_len",
        "u,1,fd00::1/128,128,a,b": None,
        "u,1,::/0,,a,b": None,
        "u,1,1:2:3:4:5:6:7:8/128,,a,b": None,
        "u,1,1:2:3:4:5:6:7::/112,,a,b": None,
        "u,1,1:2:3:4:5:6:7:8::/128,,a,b": "prefix",
        "u,1,1::2::3/128,,a,b": "prefix",
        "u,1,:1::/128,,a,b": "prefix",
        "u,1,10.0.0.0/8,7,a,b": "max_len",
        "u,1,10.0.0.0/8,+9,a,b": "max_len",
        "u,1,10.0.0.0/8,32,a,b": None,
    }
    assert dict(zip(cases, reasons(*cases, chunk=chunk))) == cases


def test_lines_that_are_no_rows():
    assert reasons("", "  ", "# x", "% y", "URI,ASN", None) == []


def test_machine_equals_a_byte_loop():
    rng = random.Random(4)
    lines = ["".join(rng.choice('ab ,"') for _ in range(rng.randrange(1, 60))).encode() for _ in range(400)]
    data = np.frombuffer(b"".join(lines), dtype=np.uint8)
    sizes = np.array([len(x) for x in lines])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    for chunk in (1, 4, 16, 64):
        commas, bad, final = rl.run_machine(data, starts, sizes, chunk)
        commas = set(commas.tolist())
        for line, start, b, f in zip(lines, starts, bad, final):
            state, first, cuts = rl.START, -1, set()
            for i, byte in enumerate(line):
                state = rl.STEP[state, rl._CLASS[byte]]
                if state == rl.BROKEN and first < 0:
                    first = i
                if byte == ord(",") and state == rl.START:
                    cuts.add(start + i)
            assert first == b and cuts == {c for c in commas if start <= c < start + len(line)}
            assert (state == rl.QUOTED) == (f == rl.QUOTED)


def test_table_with_nulls_long_lines_and_repeats(spark):
    long_line = '"' + "x" * 500_000 + '",1,10.0.0.0/8,8,a,b'
    rows = [(1, None, "e"), (2, GOOD, "e"), (2, GOOD, "e"), (3, long_line, None), (4, long_line[1:], None), (None, "x", "e")]
    df = spark.createDataFrame(rows, "line_id long, raw_line string, reason string")
    got = {(r.line_id, r.reason, r.error_offset) for r in rl.parse_roa_lines(df).collect()}
    assert got == {(2, None, None), (3, None, None), (4, "quoting", 500_000), (None, "column_count", 1)}
    assert rl.parse_roa_lines(df).count() == 5
    assert rl.parse_roa_lines(df.limit(0)).count() == 0
