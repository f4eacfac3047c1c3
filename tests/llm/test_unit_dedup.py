import random
import re

import pytest

from quire.llm.unit_dedup import BETWEEN, PASSAGE, WINDOW, unit_dedup, units


def plain(rows, kind, least):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        text = t or ""
        found = units(text, kind)
        repeated = []
        for a, z in found:
            name = " ".join(text[a:z].lower().split())
            repeated.append(bool(name) and name in seen)
            seen.add(name)
        gone, k = [False] * len(text), 0
        while k < len(found):
            j = k
            while j < len(found) and repeated[j]:
                j += 1
            if j > k and len(text[found[k][0] : found[j - 1][1]].split()) >= least:
                a = found[k - 1][1] if k else 0
                z = found[j - 1][1] if k else found[j][0] if j < len(found) else len(text)
                gone[a:z] = [True] * (z - a)
            k = max(j, k + 1)
        out[i] = (len(found), sum(repeated), "".join(c for c, g in zip(text, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("kind", sorted(BETWEEN))
def test_matches_a_plain_pass_in_order(spark, odd_rows, kind):
    shared = "A passage that many documents share, word for word. It has two sentences and more than ten words."
    rows = [(i, None if t is None else re.sub(" Amet\\. ", f" {shared} Amet. ", t, count=1) if i % 3 else t + "\n\n" + shared.upper()) for i, t in odd_rows[:-2]]
    rows += [(300 + i, f"Start {i}.\n{shared}\nEnd {i}.") for i in range(40)]
    got = unit_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), kind, 8).collect()
    assert {r.doc_id: (r.n_units, r.n_repeated, r.kept) for r in got} == plain(rows, kind, 8)
    texts = dict(rows)
    for r in got:
        text, parts, at = texts[r.doc_id] or "", [], 0
        for s in r.spans:
            parts.append(text[at : s.start])
            at = s.end
        assert "".join(parts) + text[at:] == r.kept
    if kind == "sentence":
        assert sum(shared.lower() in r.kept.lower() for r in got) == 1


def test_short_repeats_stay(spark):
    rows = [(1, "Yes. No."), (2, "Yes. No. One two three four five six seven eight nine ten."), (3, "One two three four five six seven eight nine ten. Yes.")]
    got = {r.doc_id: r.kept for r in unit_dedup(spark.createDataFrame(rows, "doc_id long, text string"), "sentence", 10).collect()}
    assert got == {1: "Yes. No.", 2: rows[1][1], 3: ""}


def test_repeated_ids_null_ids_and_empty_table(spark):
    line = "one two three four five six seven eight nine ten eleven"
    frame = spark.createDataFrame([(1, line, 0), (1, line, 0), (None, line, 0), (2, None, 0)], "doc_id long, text string, kept int")
    got = sorted((r.doc_id or 0, r.kept) for r in unit_dedup(frame).collect())
    assert got == [(0, ""), (1, ""), (1, line), (2, "")]
    assert unit_dedup(frame.limit(0)).count() == 0


def test_passages_go_wherever_they_start(spark):
    rng = random.Random(8)

    def prose(count):
        return " ".join(f"w{rng.randrange(9000)}" for _ in range(count))

    shared = [prose(n) for n in (50, 55, 60, 80, 200)]
    rows, left = [(k, text) for k, text in enumerate(shared)], {}
    for i in range(60):
        own = prose(40 + i), prose(30)
        left[100 + i] = own
        rows.append((100 + i, f"{own[0]} {shared[i % 5].upper() if i % 2 else shared[i % 5]} {own[1]}"))
    got = {r.doc_id: r for r in unit_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), whole=True).collect()}
    assert all(got[k].kept == text for k, text in enumerate(shared))
    for i, (before, after) in left.items():
        kept, stay = got[i].kept.split(), len(before.split()) + len(after.split())
        assert kept[: len(before.split())] == before.split() and kept[-30:] == after.split()
        assert len(kept) - stay <= 4 * WINDOW - 2 and got[i].spans
    text, parts, at = dict(rows)[100], [], 0
    for s in got[100].spans:
        parts.append(text[at : s.start])
        at = s.end
    assert "".join(parts) + text[at:] == got[100].kept


def test_a_text_of_one_word_again_and_again_keeps_its_first_passage(spark):
    rows = [(1, "a " * 200), (2, "x y " * 300)]
    got = {r.doc_id: r.kept.split() for r in unit_dedup(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()}
    assert PASSAGE <= len(got[1]) < 4 * PASSAGE and PASSAGE <= len(got[2]) < 4 * PASSAGE


def test_every_repeated_line_goes(spark):
    rows = [(1, "All rights reserved.\nOne text of its own."), (2, "Another text.\nALL  rights reserved.\nIts end."), (3, "Says so: all rights reserved. Yes."), (4, "All rights reserved.")]
    got = {r.doc_id: r.kept for r in unit_dedup(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()}
    assert got == {1: rows[0][1], 2: "Another text.\nIts end.", 3: rows[2][1], 4: ""}
