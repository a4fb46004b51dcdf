"""Overlap of neighbours against all lengths, order of chunks, and offsets on exact prefixes."""

import random
import re

from codexmill.operators import blocks, preparation

CHUNKS = "parent_id string, position int, text string"


def longest(a, b):
    return max((k for k in range(min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k]), default=0)


def test_boundaries_against_all_lengths(spark):
    rng = random.Random(6)
    texts = ["\n".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(400)] + [None, "", "x", "x"]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], CHUNKS).repartition(3)
    got = {r.position: r for r in blocks.boundary_overlaps(df).collect()}
    lines = [(t or "").split("\n") for t in texts]
    assert len(got) == len(texts) - 1
    for i in range(len(texts) - 1):
        k = longest(lines[i], lines[i + 1])
        assert (got[i].n_shared, got[i].shared_chars) == (k, sum(map(len, lines[i + 1][:k]))), (lines[i], lines[i + 1])
    assert got[len(texts) - 2].near_duplicate and not got[400].near_duplicate


def test_overlap_by_parent(spark):
    rows = [("ok", 1, "a\nb"), ("ok", 2, "b\nc"), ("ok", 3, "c\nd"), ("gap", 1, "a\nb"), ("gap", 2, "c"), ("order", 2, "a\nb"), ("order", 1, "b\nc"), ("two", 1, "a\nb\nc"), ("two", 2, "b\nc\nd"), ("one", 1, "a"), ("none", 1, "a"), ("none", 2, "a")]
    parents = spark.createDataFrame([("ok", list("abcd")), ("gap", list("abc")), ("order", list("abc")), ("two", list("abcd")), ("one", ["a"])], "parent_id string, paragraphs array<string>")
    got = {r.parent_id: tuple(r)[1:] for r in blocks.overlap_by_parent(spark.createDataFrame(rows, CHUNKS), parents).collect()}
    assert got == {
        "ok": (3, True, True, 2, 2, 0), "gap": (2, False, True, 0, 0, 0), "order": (2, False, False, 0, 0, 0), "two": (2, False, True, 2, 2, 0), "none": (2, True, False, 1, 1, 1),
    }
    assert blocks.overlap_by_parent(spark.createDataFrame([], CHUNKS), parents).count() == 0


#: Tokens that go over a gap: a word with the spaces behind it, and 'a b' as one. A lambda, so that workers get it by value.
merging = lambda text: re.findall(r"a b|\S+\s*|\s+", text)


def last_break(text, at):
    """Behind the last stop before `at`: no token of `merging` goes over '. '."""
    return text.rfind(". ", 0, at) + 2 if ". " in text[:at] and text.rfind(". ", 0, at) + 2 <= at else 0


def test_offsets_on_exact_prefixes(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for u in range(40):
        parts = ["".join(rng.choices(["a", "b", " ", "xy", "q. r"], k=rng.randint(1, 6))).strip() or "z" for _ in range(rng.randint(0, 6))]
        text = rng.choice(["", "head "]) + rng.choice([" ", "\n", ""]).join(parts)
        cursor, found = 0, []
        for i, p in enumerate(parts):
            first = text.index(p, cursor)
            cursor = first + len(p)
            found.append((i + 5, len(merging(text[:first])), len(merging(text[:cursor]))))
        rows.append((u, text, [(i + 5, p) for i, p in enumerate(parts)]))
        want[u] = found
    kind = "unit_id int, text string, paragraphs array<struct<order:int,text:string>>"
    got = {r.unit_id: r for r in preparation.text_offsets(spark.createDataFrame(rows, kind), merging).collect()}
    assert all([tuple(x) for x in got[u].intervals] == want[u] and got[u].error is None for u in want)
    sums = sum(len(merging(p)) for _, p in rows[0][2])
    assert any(w and w[-1][2] != sum(len(merging(p)) for _, p in r[2]) for w, r in zip(want.values(), rows)), sums


def test_open_tails_only():
    asked = []
    text = ". ".join(f"word{i} and more" for i in range(200))
    parts = [(i, f"word{i} and more") for i in range(200)]
    count = lambda t: asked.append(len(t)) or merging(t)
    got, error = preparation.prefix_offsets(text, parts, count, last_break)
    assert error is None and got == preparation.prefix_offsets(text, parts, merging)[0]
    assert sum(asked) < 4 * len(text)  # every prefix anew would be a hundred times the text


def test_lost_paragraphs_are_errors(spark):
    kind = "unit_id int, text string, paragraphs array<struct<order:int,text:string>>"
    rows = [(1, "a b c", [(1, "a"), (2, "zz"), (3, "c")]), (2, "a", [(1, ""), (2, "a")]), (3, None, None), (4, "b a", [(1, "a"), (2, "b")]), (5, "x", [(1, None)])]
    got = {r.unit_id: (len(r.intervals), r.error) for r in preparation.text_offsets(spark.createDataFrame(rows, kind), merging).collect()}
    assert got == {1: (1, "paragraph 2 is not in the text"), 2: (0, "paragraph 1 is empty"), 3: (0, None), 4: (1, "paragraph 2 is not in the text"), 5: (0, "paragraph 1 is empty")}
