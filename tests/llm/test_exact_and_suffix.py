import hashlib
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.common import heavy_hitters
from quire.llm.exact_dedup import exact_dedup
from quire.llm.lyndon import suffix_array
from quire.llm.suffix_dedup import suffix_dedup
from quire.staging import shared_dir


def test_exact_matches_plain_grouping(spark, odd_rows):
    rows = odd_rows + [(500 + i, "many copies " * 3) for i in range(300)] + [(900, "manycopies many copiesmany  copies   ")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for _, i in g}
    for counters in (1024, 1):
        got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), counters=counters).collect()
        assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
        assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want


def test_exact_null_ids_and_empty_table(spark):
    got = exact_dedup(spark.createDataFrame([(None, "a b"), (4, "ab "), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 4, 2, False), (4, 4, 2, True)]
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_frequent_values_are_always_found(spark):
    values = [(f"v{i % 400}",) for i in range(2000)] + [("hot",)] * 700 + [("warm",)] * 500
    found = {r.v for r in heavy_hitters(spark.createDataFrame(values, "v string").repartition(6), "v", 16).collect()}
    assert {"hot", "warm"} <= found and len(found) <= 16


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60) | st.lists(st.integers(0, 255), max_size=60))
def test_suffix_array_is_sorted(symbols):
    assert suffix_array(np.array(symbols, np.int64)) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def plain_cut(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        spans = sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, bytes(x for x, g in zip(data, gone, strict=True) if not g))
    return out


def test_suffix_matches_every_string(spark, odd_rows):
    rows = odd_rows[:-2]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_cut(rows, 100)
    for most in (250_000, 150):  # the second divides the anchors' contexts time and again
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(frame, most_symbols=most).collect()}
        assert got == want


def test_suffix_repeated_ids_and_empty_table(spark):
    text = "".join(chr(97 + k * k % 23) for k in range(300))
    got = suffix_dedup(spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got)[0] == (0, 300, 300)
    assert sum(r.n_removed for r in got) >= 600
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_go_when_they_are_grouped(spark, odd_rows):
    before = set(Path(shared_dir(spark)).glob("suffix-runs-*"))
    suffix_dedup(spark.createDataFrame(odd_rows, "doc_id long, text string"), length=60, core=24)
    assert set(Path(shared_dir(spark)).glob("suffix-runs-*")) == before
