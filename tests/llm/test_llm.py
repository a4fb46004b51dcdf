import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from codexmill.llm import bpe, decontam, fm, html, licenses, rules, simhash, substrings, tokenfiles, toxicity
from codexmill.llm.graph import connected_components
from codexmill.llm.queries import vocabulary

DOCS = "doc_id long, text string, fp string, rank int"


def docs(spark, texts):
    """Extra columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)


AWKWARD = [None, "", " \n\t ", "a", "a b", "A B c", "word " * 3000, "é日本 x", "a b", "\x00 q", "x" * 5000]


@pytest.fixture(scope="module")
def awkward(spark):
    return docs(spark, AWKWARD)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts, labels = [], []
    for i in range(240):
        t = list(rng.choice(words, int(rng.integers(60, 200))))
        toxic = i % 4 == 0
        if toxic:
            for p in rng.integers(0, len(t), 6):
                t[p] = "vile" if p % 2 else "nasty"
        bad = i % 5 == 1
        texts.append(" ".join(t) if not bad else " ".join(x + "###" for x in t))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return docs(spark, texts), spark.createDataFrame([*labels, (None, 1, 1), (7, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(words) < 400 else set(range(len(words)))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics(spark, awkward):
    more = docs(spark, ["a b c a b c", "a a a a", "l\nl\n \n \nm", "x#*$%&|<>y", "a\x0bb\x0cc\rd"])
    for df in (awkward, more):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in rules.statistics(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _base(texts[r.doc_id]), texts[r.doc_id]


def test_rules_learn_and_apply(spark, corpus, nothing):
    d, labels = corpus
    got = {r.doc_id: r.kept for r in rules.quality_rules(d, labels).collect()}
    wrong = sum(got[i] != (i % 5 != 1) for i in got)
    assert wrong <= 2
    assert rules.quality_rules(nothing, labels).count() == 0
    assert rules.quality_rules(d, labels.limit(0)).where("kept = base_failed").count() == 0


def test_license_scan(spark):
    files = spark.createDataFrame(
        [("a/LICENSE", "Released under the MIT License.", True), ("a/b/c", "text", False), ("a/b/d", "Licensed under the Apache License, Version 2.0.", False), ("e/f", None, False), (None, "x", False), ("a/b/c", "text", False), ("e/g", "licence fees are due", False)],
        "path string, text string, is_license_file boolean",
    )
    got = sorted((r.path or "", r.own_license or "", r.license or "", r.license_from or "") for r in licenses.license_scan(files).collect())
    assert got == sorted([("a/LICENSE", "MIT", "MIT", ""), ("a/b/c", "", "MIT", "a"), ("a/b/c", "", "MIT", "a"), ("a/b/d", "Apache-2.0", "Apache-2.0", ""), ("e/f", "", "", ""), ("", "", "", ""), ("e/g", "", "", "")])


def test_fm_identity_and_learning(spark, corpus, awkward, nothing):
    rng = np.random.default_rng(0)
    w0, w, v = 0.3, rng.normal(size=50), rng.normal(size=(50, 4))
    idx, x = np.array([1, 5, 9, 30]), rng.normal(size=4)
    pairs = sum(v[idx[a]] @ v[idx[b]] * x[a] * x[b] for a in range(4) for b in range(a + 1, 4))
    assert fm.fm_score(w0, w, v, idx, x) == pytest.approx(w0 + w[idx] @ x + pairs)
    d, labels = corpus
    got = fm.quality_scores(d, labels).where("held_out").collect()
    assert got and np.mean([r.predicted == int(r.doc_id % 5 != 1) for r in got]) > 0.9
    assert fm.quality_scores(awkward, labels).where("score between 0 and 1").count() == len(AWKWARD)
    assert fm.quality_scores(nothing, labels).count() == 0


def test_toxicity(spark, corpus, awkward, nothing):
    d, labels = corpus
    got = toxicity.toxicity(d, labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.9
    assert toxicity.toxicity(awkward, labels).where("score between 0 and 1").count() == len(AWKWARD)
    assert toxicity.toxicity(nothing, labels).count() == 0


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(21)
    rows = [(np.unique(rng.integers(0, 40, 9)), int(rng.integers(2))) for _ in range(60)]
    z, n = [0.0] * 41, [0.0] * 41

    def weight(j):
        l1, l2 = (0.0, 0.0) if j == 40 else (toxicity.L1, toxicity.L2)
        if abs(z[j]) <= l1:
            return 0.0
        return -(z[j] - (l1 if z[j] > 0 else -l1)) / ((toxicity.BETA + n[j] ** 0.5) / toxicity.ALPHA + l2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(rows)):
            used = [*rows[i][0].tolist(), 40]
            w = {j: weight(j) for j in used}
            g = 1 / (1 + np.exp(-sum(w.values()))) - rows[i][1]
            for j in used:
                step = ((n[j] + g * g) ** 0.5 - n[j] ** 0.5) / toxicity.ALPHA
                z[j] += g - step * w[j]
                n[j] += g * g
    bias, kept, weights = toxicity.ftrl(rows, 40)
    assert bias == pytest.approx(weight(40))
    assert dict(zip(kept.tolist(), weights)) == pytest.approx({j: weight(j) for j in range(40) if weight(j)})


def test_scores_never_take_a_column_of_the_documents(spark, corpus):
    import corpus_pipeline

    d, labels = corpus
    with pytest.raises(ValueError):
        toxicity.score(d.withColumn("toxicity", F.lit(9.5)), toxicity.fit(d, labels))
    name = "toxicity"
    clash = d.withColumn(name, F.lit(9.5)).withColumn("toxicity_", F.lit("x"))
    model = toxicity.fit(d, labels)
    scored = toxicity.score(clash, model, name="toxicity__")
    assert scored.columns == [*clash.columns, "toxicity__"] and scored.where("toxicity = 9.5 and toxicity_ = 'x'").count() == d.count()
    assert clash.columns == [*d.columns, "toxicity", "toxicity_"] and corpus_pipeline.STAGES[0][1] is corpus_pipeline.drop_toxic


def test_rule_statistics_equal_their_sql(spark):
    import duckdb

    from codexmill.llm import sql

    where = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{where}'")
    want = con.execute(sql.OP1_STATS).df()
    got = rules.statistics(spark.read.parquet(where)).select(*want.columns).toPandas()
    key = list(want.columns)
    assert got.sort_values(key).reset_index(drop=True).astype(want.dtypes.to_dict()).equals(want.sort_values(key).reset_index(drop=True))


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 7, 100, 4097):
        got = tokenfiles.permuted(spark.range(n).withColumnRenamed("id", "index"), "index", n).select("slot").collect()
        assert sorted(r.slot for r in got) == list(range(n))


def test_token_files_round_trip(spark, awkward, nothing, tmp_path):
    manifest, folder = tokenfiles.write_training_order(awkward, vocabulary(), str(tmp_path / "t"), length=16, shard_rows=50)
    rows = sorted(manifest.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    back = tokenfiles.read_slots(spark, folder, 0, len(rows), 16, 50)
    found = {}
    for r, ids in zip(rows, back):
        assert hashlib.sha256(ids.tobytes()).hexdigest() == r.sha256
        assert r.n_tokens == sum(p.n for p in r.pieces) and list(r.doc_ids) == [p.doc_id for p in r.pieces]
        assert all(p.first == sum(q.n for q in r.pieces[:k]) for k, p in enumerate(r.pieces)) and (ids[r.n_tokens :] == 50256).all()
        for p in r.pieces:
            found.setdefault(p.doc_id, []).append((p.doc_offset, ids[p.first : p.first + p.n].tolist()))
    # only the last sequence of a partition is filled up
    assert sum(r.n_tokens < 16 for r in rows) <= awkward.rdd.getNumPartitions()
    coder = bpe.load(vocabulary())
    for i, text in enumerate(AWKWARD):
        ids = []
        for at, part in sorted(found[i]):
            assert at == len(ids)
            ids += part
        assert ids[-1] == 50256 and coder.decode(ids[:-1]) == (text or "")
    part = tokenfiles.read_slots(spark, folder, 45, 20, 16, 50)
    assert [p.tolist() for p in part] == [p.tolist() for p in back[45:65]]
    assert tokenfiles.write_training_order(nothing, vocabulary(), str(tmp_path / "e"))[0].count() == 0


def test_shards_are_written_in_rounds(spark, tmp_path, monkeypatch):
    """No round shuffles much more than its share of the records, and the folder counts as whole after the last only."""
    written, folder, text = [], str(tmp_path / "t"), DataFrameWriter.text

    def spy(self, path):
        rows = self._df.groupBy("shard").count().collect()
        text(self, path)
        written.append(({r.shard for r in rows}, sum(r["count"] for r in rows), (tmp_path / "t/_SUCCESS").exists()))

    monkeypatch.setattr(DataFrameWriter, "text", spy)
    long = docs(spark, [f"{i} " + "some words " * 150 for i in range(20)])
    manifest, _ = tokenfiles.write_training_order(long, vocabulary(), folder, length=16, shard_rows=50)
    rows = sorted(manifest.collect(), key=lambda r: r.slot)
    shards, rounds = -(-len(rows) // 50), tokenfiles.ROUNDS_OF_SHARDS
    assert len(written) == rounds > 1 and [whole for *_, whole in written] == [False] * (rounds - 1) + [True]
    assert max(n for _, n, _ in written) <= 50 * -(-shards // rounds) and sum(n for _, n, _ in written) == len(rows)
    assert sorted(s for some, *_ in written for s in some) == list(range(shards))
    back = tokenfiles.read_slots(spark, folder, 0, len(rows), 16, 50)
    assert [hashlib.sha256(ids.tobytes()).hexdigest() for ids in back] == [r.sha256 for r in rows]
    with pytest.raises(AnalysisException):  # a folder that is there is not added to
        tokenfiles.write_training_order(long, vocabulary(), folder, length=16, shard_rows=50)


def test_html_layout():
    page = "<p>a<p>b <b>c</b>\n d<ul><li>x<li>y</ul><table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>s<td>22</table>t<div hidden>no</div><span style='display: none'>no</span><script>var t='</p>'</script>&amp;<pre>  q\n   r</pre>"
    assert html.extract(page) == "a\n\nb c d\n\n- x\n- y\n\nName       N\nlong name  1\ns          22\n\nt&\n\n  q\n   r"
    assert html.extract(None) == html.extract("") == html.extract("<p></div></p>") == ""
    assert "deep" in html.extract("<div>" * 5000 + "deep")
    assert html.extract("<ol start=3><li>a<li>b<ul><li>c</ul></ol>").startswith("3. a\n4. b")


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x", 0), (2, None, None, 0)], "page_id long, url string, html string, text int")
    assert [(r.page_id, r.text, r.n_lines) for r in html.extract_pages(pages).orderBy("page_id").collect()] == [(1, "x", 1), (2, "", 0)]


def test_decontamination(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "short item"), (3, None), (None, "a b"), (10, "a B!")], "item_id long, text string")
    d = docs(spark, ["zero ONE two-three four five six seven eight. nine ten short item", "short, ITEM", *AWKWARD, "one two three"])
    got = {r.doc_id: r for r in decontam.decontaminate(d, items).collect()}
    assert (got[0].n_words, got[0].n_hit, got[0].n_items, got[0].contaminated) == (13, 11, 2, True)
    assert got[0].items_sha256 == hashlib.sha256(b"1,2").hexdigest()
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (2, 1, False)
    assert got[6].n_hit == 2 and got[7].n_hit == 2 and got[2].n_words == 0
    blocks = {r.doc_id: r for r in decontam.decontaminate(d, items, block_bytes=20).collect()}
    assert blocks == got
    assert decontam.decontaminate(nothing, items).count() == 0
    assert decontam.decontaminate(d, items.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    d = docs(spark, ["alpha x x beta", "beta y y y y y y y alpha"])
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    got = {r.doc_id: list(r["items"]) for r in decontam.matches(decontam.build_index(d), items, span=4).collect()}
    assert got == {0: [1], 1: []}


def test_bpe_equals_the_library(spark, awkward):
    import random

    from tokenizers import Tokenizer

    mine, theirs, rng = bpe.load(vocabulary()), Tokenizer.from_file(vocabulary()), random.Random(5)
    alphabet = [*"ab 'sdtlmre  \n\n\t\r09.,!é日　\xa0\x1c\x85​﻿😀", "<|endoftext|>", "'ll", "A" * 60, "     ", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(25)))
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids and mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    for r in bpe.encode_decode(awkward, vocabulary(), digests=False).collect():
        assert r.ids == theirs.encode(AWKWARD[r.doc_id] or "", add_special_tokens=False).ids and r.decoded == (AWKWARD[r.doc_id] or "")


def test_bpe_of_words_with_stops_and_cuts_equals_the_library(monkeypatch):
    """Words, words before a stop and cut fragments have short ways of their own, with memos that overflow as well."""
    import random

    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "MEMO_ROWS", 50)
    mine, theirs, rng = bpe.ByteBpe(vocabulary()), Tokenizer.from_file(vocabulary()), random.Random(8)
    for _ in range(2000):
        words = ("".join(rng.choices(["é", "ŉ", "ªb", "qx", "the", "s", "日", "zj", "ing", "'", "7", "\u0301"], k=rng.randrange(4))) + rng.choice(["", *".,;:!?", "..", "'", ".5", "é,"]) for _ in range(8))
        text = "".join(w + rng.choice(" \n") for w in words).strip()
        assert mine.encode(text) == theirs.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("run_bytes", [1 << 20, 200, 1])
def test_a_column_is_encoded_as_its_texts(monkeypatch, run_bytes):
    import random

    import pyarrow as pa

    monkeypatch.setattr(bpe, "MEMO_ROWS", 50)
    mine, rng = bpe.ByteBpe(vocabulary()), random.Random(9)
    parts = ["é", "Ñ", "×", "÷", "ª", "ŉ", "qx", "the", "zj", "ing", "'ll", "7", "日", "\u0301", "A" * 70, *".,;:!?", "..", " ", " ", " ", "\n", "\n", "\t", "\xa0", "\x85", "\u2028", "“", "\u3000", "\ufeff", "<|endoftext|>", "\x00", "\x1c"]
    weights = [4] * 15 + [1] * 7 + [9, 9, 9, 4, 4] + [0.1] * 10
    for kind in (pa.string(), pa.large_string()):
        texts = [*AWKWARD, "", None, " a", "a ", "\na", "a\n", " ", "\n", "a", " b", "\n", "\nc", ".", " .", "\n.", "é", *("".join(rng.choices(parts, weights, k=rng.randrange(30))) for _ in range(1500))]
        column = pa.array(["cut off", *texts, None], kind).slice(1, len(texts))
        for text, got in zip(texts, mine.encode_column(column, run_bytes), strict=True):
            assert got == mine.encode_packed(text or ""), repr(text)
    for empty in (column.slice(0, 0), pa.array([], pa.string())):
        assert list(mine.encode_column(empty)) == []
    assert list(mine.encode_column(pa.array([None, ""], pa.string()))) == [b"", b""]


def test_odd_texts_are_those_with_other_white_space():
    """A text's last character and the next one's first are no pair."""
    import pyarrow as pa

    marks = [c for c in map(chr, range(0x3100)) if c.isspace() or c in "\u180e\u200b"] + ["\ufeff", "é", "“", "\u2030", "日", "\uf8ff"]
    texts = [t for c in marks for t in (c, f"a{c}b", f"é{c} b", f"日 {c}", f"a\n{c}", f"{c}{c}", f" b\n{c}c")] + [" ", "\n", " a ", "a", " "]
    odd = bpe._odd(pa.array(texts, pa.string()))
    for text, found in zip(texts, odd.tolist(), strict=True):
        assert found == ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in (*bpe._RARE_ASCII, *bpe._RARE))), repr(text)


def test_a_column_merges_each_fragment_once():
    """20,000 words of 26: per text, each would be looked up as a Python string."""
    import pyarrow as pa

    mine = bpe.ByteBpe(vocabulary())
    asked = []
    mine.fragments = type("Counted", (dict,), {"__getitem__": lambda self, f: asked.append(f) or mine._fragment("", f)})()
    mine.spaced = mine.bare = mine.broken = None
    texts = [" ".join("word" + chr(97 + (u + k) % 26) for k in range(20)) for u in range(1000)]
    assert b"".join(mine.encode_column(pa.array(texts))) == b"".join(map(bpe.load(vocabulary()).encode_packed, texts))
    assert len(asked) <= 200


def test_doubled_white_space_is_that_of_the_pattern():
    marks = [c for c in map(chr, range(0x110000)) if c.isspace() or re.match(r"\s", c) or c in "\u180e\u200b\ufeff"]
    for c in marks:
        for text in (c, f"a{c}b", f"é{c} b", f"日 {c}", f"a\n{c}", f"{c}{c}", f"a b\n{c}c"):
            assert bpe._doubled(text) == (bpe._PAIR(text) is not None), repr(text)


def test_compact_windows_cover_each_run_once():
    rng = np.random.default_rng(1)
    for n, top in ((46, 5), (120, 5), (400, 10**6)):
        v = rng.integers(1, top, n).astype(np.uint64)
        c, left, right = substrings.compact_windows(v)
        for i in range(n - 45):
            held = [k for k in range(len(c)) if left[k] <= i and i + 45 <= right[k] and i <= c[k] <= i + 45]
            assert len(held) == 1 and c[held[0]] == i + int(np.argmin(v[i : i + 46]))


def test_window_centres_and_sides_equal_the_windows():
    rng = np.random.default_rng(8)
    for most in (2, 5, 40, 2**32):
        for n in (0, 10, 45, 46, 47, 300, 2000):
            v = rng.integers(1, most, n, dtype=np.uint64, endpoint=True).clip(1, 2**32 - 1).astype(np.uint32)
            v[rng.random(n) < 0.004] = 0
            edge = np.zeros(substrings._EDGE, np.uint32)
            tables = substrings._doubled(np.concatenate([edge, v, edge]), substrings.REACH)
            want = substrings.compact_windows(v)[0].tolist()
            assert n < substrings.WIDTH or substrings._window_centres(v, tables).tolist() == want
    flat = rng.integers(1, 30, 900, dtype=np.uint64)
    flat[[0, 200, 899]] = 0
    keys, at = substrings.signatures(flat, 1)
    v = (substrings.mix(flat + substrings._P) >> np.uint64(32)).astype(np.uint32)
    v[flat == 0] = 0
    c, lo, hi = substrings.compact_windows(v)
    assert at.tolist() == [*c[hi - c >= substrings.HALF].tolist(), *c[c - lo >= substrings.HALF].tolist()]


def test_shingles_of_many_texts_are_those_of_each():
    texts = [b"", b"A b", b" ", b"a b c d e f", "\u00e9 b\tC d\x0be f g".encode(), b"x" * 70, b"", b"one two three four five", b" \n"]
    flat, starts, ends = substrings.shingles_of(texts)
    got = [substrings._own(flat, s, e).tolist() for s, e in zip(starts, ends)]
    assert got == [substrings.shingle_hashes(t).tolist() for t in texts]
    assert [len(x) for x in got] == [max(0, len(t.decode().split()) - 4) for t in texts]


def test_repeated_passages(spark, nothing):
    rng = np.random.default_rng(2)
    some = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 10**9, n))
    shared, edited = some(60), None
    edited = shared.split()
    edited[30] = "changed"
    long = some(120).split()
    near = long[:60] + ["new"] + long[61:]
    texts = [f"{some(30)} {shared} {some(40)}", f"{some(70)} {shared.upper()} {some(9)}", some(200), None, "", " ".join(long), " ".join(near), some(30), f"{shared} {some(5)} {shared}"]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in substrings.substring_duplicates(d).collect()}
    assert [(s.first, s.last) for s in got[1].spans] == [(70, 129)] and list(got[1].sources) == [0]
    assert all(got[i].n_repeated == 0 for i in (0, 2, 3, 4, 5, 7))
    assert got[6].n_repeated >= 100
    assert got[8].n_repeated == 120
    kept = {r.doc_id: r.text for r in substrings.remove_repeats(d).collect()}
    assert kept[0] == texts[0] and kept[2] == texts[2] and kept[3] is None and shared.upper() not in kept[1]
    assert kept[1].split() == texts[1].split()[:70] + texts[1].split()[130:]
    assert substrings.substring_duplicates(nothing).count() == 0


def _simhash_brute(fps, ids):
    comp = list(range(len(fps)))
    for _ in range(len(fps)):
        moved = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 2 and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    moved = True
        if not moved:
            break
    return {ids[i]: min(ids[k] for k in range(len(fps)) if comp[k] == comp[i]) for i in range(len(fps))}


@pytest.mark.parametrize("bucket_rows", [simhash.BUCKET_ROWS, 3])
def test_simhash_links(spark, monkeypatch, bucket_rows):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    fps = [b ^ (1 << int(a)) ^ (1 << int(c)) for b in base for a, c in rng.integers(0, 64, (5, 2))] + base + [0, 3, 2**64 - 1]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in sorted(set(signed))], "fp long")
    groups = {r.node: r.component for r in connected_components(simhash.links(nodes, bucket_rows=bucket_rows)).collect()}
    want = _simhash_brute(fps, signed)
    low = {}
    for f in set(signed):
        low.setdefault(want[f], []).append(f)
    for members in low.values():
        assert {groups.get(m, m) for m in members} == {min(members)}


def test_simhash_query(spark, awkward, nothing):
    got = {r.doc_id: r for r in simhash.near_duplicates(awkward).collect()}
    assert all(got[i].fingerprint == "0" * 16 and got[i].component_id == 0 for i in (0, 1, 2))
    assert got[4].fingerprint == got[8].fingerprint and got[8].component_id == got[4].component_id == 4
    assert simhash.near_duplicates(nothing).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 6), (200, 201), (None, 1)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    stages = [n for n, _ in corpus_pipeline.STAGES]
    assert len(stages) == 5
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = now.columns, {now.count()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, d).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == columns
    assert 0 < now.count() < max(seen)
    assert corpus_pipeline.STAGES[-1][1](spark, now, d).count() == now.count()


def test_labelled_texts_take_one_row_of_a_repeated_id(spark):
    from codexmill.llm.common import labelled_texts

    texts = spark.createDataFrame([(1, f"t{i}", 5) for i in range(50)] + [(2, None, None), (None, "z", 1)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    got = sorted((r["doc_id"], bytes(r["text"]), r["n_chars"], r["label"]) for r in labelled_texts(texts, labels, "quality", 10, "n_chars").collect())
    kept = [x for x in (1, 2) if zlib.crc32(str(x).encode()) % 5]
    assert got == [x for x in ((1, b"t0", 5, 1), (2, b"", None, 0)) if x[0] in kept]


def test_repeat_words_match_counting(spark):
    texts = ["a b c a b c", "a a a a a", "a b c d", "x y z q x y z r y z q", "a b c " * 40 + "d", " ".join(f"w{i}" for i in range(300))]
    got = {r["doc_id"]: r["n_repeat_words"] for r in rules.statistics(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        assert got[i] == len({k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)})


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(substrings, "_PIECE", 16)
    substrings._powers.cache_clear()
    words = ["a", "bb", "é日本", "x" * 15, "y" * 16, "z" * 17, "w" * 70, "a\x00", "\x1c"]
    one = {w: substrings.word_hashes(w.encode()) for w in words}
    assert all(len(h) == 1 for h in one.values()) and len({int(h[0]) for h in one.values()}) == len(words)
    rng = np.random.default_rng(6)
    for _ in range(200):
        picked = [words[k] for k in rng.integers(0, len(words), 9)]
        gaps = [" \t\n\x0b\x0c\r"[k : k + 1 + k % 2] for k in rng.integers(0, 6, 10)]
        text = gaps[0] + "".join(w + g for w, g in zip(picked, gaps[1:]))
        assert substrings.word_hashes(text.encode()).tolist() == [int(one[w][0]) for w in picked]
    assert len(substrings.word_hashes(b"")) == len(substrings.word_hashes(b"  \n" * 40)) == 0
    substrings._powers.cache_clear()


def test_repeats_of_a_later_holder_are_found(spark):
    rng = np.random.default_rng(8)
    some = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    texts, lost = [], []
    for _ in range(100):
        passage = some(50)
        # under 0.8 of the passage, in many contexts: more than the leaders of one round
        texts += [" ".join(some(20) + passage[:44] + some(20)) for _ in range(1 if len(texts) else 40)]
        texts += [" ".join(some(20) + passage + some(20)) for _ in range(2)]
        lost.append(len(texts) - 1)
    got = {r.doc_id: r for r in substrings.substring_duplicates(docs(spark, texts)).collect()}
    assert all(got[i].n_repeated >= 50 and i - 1 in got[i].sources for i in lost)


def test_near_passages_against_brute_force(spark):
    rng = np.random.default_rng(9)
    some = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    low = lambda words: (substrings.shingle_hashes(" ".join(words).encode()) >> np.uint64(32)).astype("<u4")
    texts, want = [], {}
    for n in (50, 55, 60) * 100:
        passage = some(n)
        edited = list(passage)
        edited[n // 2 if len(texts) % 4 else int(rng.integers(n))] = "changed"
        a, b = some(40) + passage + some(40), some(70) + edited + some(40)
        texts += [" ".join(a), " ".join(b)]
        want[len(texts) - 1] = {w for x, y in substrings.verified_spans(low(a), low(b), 0, 0, 30) for w in range(x, y + 1)}
    got = {r.doc_id: {w for s in r.spans or [] for w in range(s.first, s.last + 1)} for r in substrings.substring_duplicates(docs(spark, texts)).collect()}
    assert sum(map(len, want.values())) > 300 * 40
    assert sum(len(w - got[i]) for i, w in want.items()) <= 0.002 * sum(map(len, want.values()))
    assert not any(got[i] for i in range(0, len(texts), 2))


def test_the_first_place_in_a_text_is_not_repeated(spark):
    rng = np.random.default_rng(10)
    some = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 10**9, n))
    cycle = " ".join(f"c{i % 3}" for i in range(120))
    d = docs(spark, [some(40) + " w" * 140, some(40) + " w" * 140 + " " + some(10), some(45) + " " + cycle])
    got = {r.doc_id: r for r in substrings.substring_duplicates(d).collect()}
    assert [(s.first, s.last) for s in got[0].spans] == [(41, 179)]
    assert [(s.first, s.last) for s in got[2].spans] == [(48, 164)]
    assert min(s.first for s in got[1].spans) >= 40
    kept = {r.doc_id: r.text.split() for r in substrings.remove_repeats(d).collect()}
    assert len(kept[0]) == 41 and len(kept[1]) >= 50 and len(kept[2]) == 48


def test_license_headers_ids_and_files(spark):
    gpl = "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version %s of the License, or\n * (at your option) any later version.\n */\nint main;"
    mit = "MIT License\n\nCopyright (c) 2020 Foo\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
    cases = [
        ("// SPDX-License-Identifier: MIT\nx", "MIT"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("# SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"), ("Apache-2.0\n", "Apache-2.0"),
        ("Licensed under the MIT license.", "MIT"), ("MIT License", "MIT"), ("Copyright (c) 2020 Foo Inc. All rights reserved.", "Proprietary"), (gpl % 3, "GPL-3.0"), (gpl % 2, "GPL-2.0"),
        ("# This work is licensed under the GNU General Public License,\n# version 3.\n\ncode", "GPL-3.0"), ("This work is licensed under the GNU General Public License.", None), ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS", "Apache-2.0"), (mit, "MIT"),
        ("the license of the code is no matter here\nand this is a comment", None),
    ]
    files = spark.createDataFrame([(f"d{i}/x/y/{i}", t, False) for i, (t, _) in enumerate(cases)] + [("p/LICENSE", mit, True), ("p/a/b/c", "x", False)], "path string, text string, is_license_file boolean")
    got = {r.path: (r.own_license, r.license, r.license_from) for r in licenses.license_scan(files).collect()}
    assert {t: got[f"d{i}/x/y/{i}"][0] for i, (t, _) in enumerate(cases)} == dict(cases)
    assert got["p/a/b/c"] == (None, "MIT", "p")


def test_html_formulas_drawings_options_and_pre():
    assert html.extract("a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>tex</annotation></math> b") == "a x=1/2 b"
    assert html.extract("a<svg><title>Plan</title><path d='M'/><g><text>north</text></g><defs><text>no</text></defs></svg>b") == "a Plan north b"
    assert html.extract("<p>c <select><option>one<option selected>two</select> d") == "c two d"
    assert html.extract("<select multiple><option>one<option>two</select>") == "one\ntwo"
    assert html.extract("<object data=x><param name=y>shown</object>") == "shown"
    assert html.extract("<head><title>t</title>lost <b>x</b>") == "lost x"
    assert html.extract("<pre>a\n<b>b</b>\nc</pre>d") == "a\nb\nc\n\nd"
    assert html.extract("<pre>\n<i>if</i> x:\n\n  y\n</pre>") == "if x:\n\n  y"


def test_html_tables_against_a_naive_grid():
    assert html.extract("<table><tr><td rowspan=2>A<td>b<tr><td>c<td>d</table>") == "A  b\n   c  d"
    assert html.extract("<table><tr><td colspan=2>wide wide wide<td>z<tr><td>1<td>2<td>3</table>") == "wide wide wide  z\n1  2            3"
    assert html.extract("<table><tr><td>a<td>" + "long " * 30 + "</table>") == "a  " + ("long " * 30).strip()
    lines = html.extract("<table><tr><td>" + "long " * 30 + "<td>b<tr><td>c<td>d</table>").split("\n")
    assert lines[0] == ("long " * 12).ljust(61) + "b" and lines[-1].index("d") == 61
    rng = np.random.default_rng(11)
    for _ in range(60):
        n_rows, page, taken, place = int(rng.integers(1, 6)), "<table>", set(), {}
        for r in range(n_rows):
            page += "<tr>"
            for k in range(int(rng.integers(1, 5))):
                wide, high = int(rng.integers(1, 4)), int(rng.integers(1, 4))
                c = next(c for c in range(100) if (r, c) not in taken)
                taken |= {(r + i, c + j) for i in range(high) for j in range(wide)}
                word = f"r{r}k{k}" + "x" * int(rng.integers(0, 9))
                place[word] = (r, c)
                page += f"<td colspan={wide} rowspan={high}>{word}"
        lines = html.extract(page + "</table>").split("\n")
        assert len(lines) == n_rows
        begins = {}
        for word, (r, c) in place.items():
            begins.setdefault(c, set()).add(lines[r].split(" ").index(word) >= 0 and lines[r].index(word))
        assert all(len(x) == 1 for x in begins.values())
        order = [x.pop() for _, x in sorted(begins.items())]
        assert order == sorted(set(order))


def test_html_visibility_against_a_plain_recursion():
    css = "<style>/* .c{display:none} */ .gone{display:none} span.veil , #v { visibility : hidden } @media print { .c { display:none } } .late{display:none} .late{display:block}</style>"
    kinds = ["", " hidden", " class='c gone'", " class=veil", " id=v", " style='visibility:visible'", " style='display:none'", " class='gone' style='display:block'", " class=late"]
    rng = np.random.default_rng(12)
    words = []

    def grow(depth, seen, veiled):
        tag, kind = ("div", "span")[int(rng.integers(2))], int(rng.choice([0, 0, 0, 0, *range(len(kinds))]))
        seen = seen and kind not in (1, 2, 6)
        veiled = True if kind == 4 or (kind == 3 and tag == "span") else False if kind == 5 else veiled
        word = f"w{len(words)}."
        words.append((word, seen and not veiled))
        inner = "".join(grow(depth + 1, seen, veiled) for _ in range(int(rng.integers(0, 4)))) if depth < 5 else ""
        return f"<{tag}{kinds[kind]}> {word} {inner}</{tag}>"

    for _ in range(40):
        words.clear()
        page = css + grow(0, True, False) + grow(0, True, False)
        assert html.extract(page).split() == [w for w, shown in words if shown]
    assert html.extract("<details>no<summary>S</summary>no</details><details open><summary>T</summary>here</details>") == "S\nT\nhere"


@pytest.mark.parametrize("tag", ["div", "span", "ul><li", "blockquote", "table><tr><td", "thead", "p><b"])
def test_html_of_any_depth(tag):
    page = "".join(f"<{tag}> w{i} " for i in range(4000)) + "<script>var x</script><i hidden>secret</i></nope> end"
    got = html.extract(page).split()
    assert [w for w in got if w not in ("-",)] == [*(f"w{i}" for i in range(4000)), "end"]


def test_html_pages_empty_and_clashing(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert html.extract_pages(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", "<p>x", "no", 9), (1, "u", "<p>x", "no", 9), (None, None, "<p>" + "y " * 400_000, "", 0)]
    got = sorted((r.page_id or 0, r.n_chars) for r in html.extract_pages(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 799_999), (1, 1), (1, 1)]


def test_pipeline_keeps_null_ids_and_texts_that_share_an_id(spark):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    some = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 10**9, n))
    a, b, c, e = some(80), some(90), some(100), some(60)
    rows = [(1, a), (5, a), (5, b), (5, b), (None, c), (None, c), (None, a), (7, f"{some(70)} {e}"), (7, f"{e} {some(80)}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, d, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, a), (5, b), (0, c), *rows[7:]])
    cut = corpus_pipeline.drop_repeated_passages(spark, spark.createDataFrame(kept, d.schema), "").collect()
    assert sum(e in r.text for r in cut if r.doc_id == 7) == 1 and len(cut) == 5
    assert {(r.doc_id, r.text) for r in cut if r.doc_id != 7} == {(1, a), (5, b), (None, c)}


def test_contaminated_rows_are_judged_each(spark, tmp_path):
    import corpus_pipeline

    items = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    bad = "alpha beta gamma delta"
    rows = [(1, bad, 5), (1, "clean", 5), (None, bad, 5), (None, "clean", 5), (2, None, 5), (3, "", 5), (4, "alpha beta", 5), (4, "alpha beta", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, contaminated int")
    kept = corpus_pipeline.drop_contaminated(spark, d, str(tmp_path))
    assert kept.columns == d.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in d.collect() if r.text != bad)
    assert corpus_pipeline.drop_contaminated(spark, d.limit(0), str(tmp_path)).count() == 0


def test_equal_segments_stay_apart_over_blocks(spark):
    items = spark.createDataFrame([(i, f"item{i} word{i}") for i in range(20)], "item_id long, text string")
    rows = [(None, "item1 word1 x"), (None, "item1 word1 x"), (None, "item2 word2 y"), (None, "other words y")] * 2
    d = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "doc_id long, text string")
    key = lambda r: (r.n_words, r.n_hit, r.n_items, r.items_sha256)
    one, many = (sorted(map(key, decontam.decontaminate(d, items, block_bytes=n).collect())) for n in (10**6, 50))
    assert len(one) == len(rows) and many == one
