"""The corpus operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import html
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rillstone.llm import fingerprint, html_text, kernels, lang_id, license_scan, mixing, near_dedup, pieces, substring_dedup, topk_search, toxicity

SYLLABLES = "an er on tha ing re the of mi ta lo ku".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def corpus(seed=1):
    """Texts with copies, shared passages, nulls, empty and long ones, repeated rows and ids."""
    rng = random.Random(seed)
    shared = prose(rng, 70)
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(24)]
    texts += [texts[0], texts[1] + " more", prose(rng, 20) + "\n" + shared, shared + "\t" + prose(rng, 30), shared[: len(shared) // 2] + " x " + shared, "", " \n ", None, "one", "é ü ß " * 60, prose(rng, 9000)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (3, "another text of the same id", None, None, None), (None, shared, "en", None, None), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACES.split(text or "") if w]


# -- substring dedup


def brute_substrings(rows, size=50):
    least = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for k in range(len(w) - size + 1 if i is not None else 0):
            key = tuple(w[k : k + size])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - size + 1 if i is not None else 0):
            if least[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1 << 23, 4000])
def test_substring_dedup(docs, chunk):
    got = substring_dedup.substring_dedup(docs.withColumn("n_words", F.lit("clash")), chunk_bytes=chunk)
    assert {"lang", "source"} <= set(got.columns)
    rows = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=repr)
    assert rows == brute_substrings(corpus())


def test_substring_dedup_removes_maximal_runs(spark):
    w = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(w)), (2, "a " + " ".join(w[10:90]) + " b")]
    r = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 2").first()
    assert (r.text, r.removed, r.n_removed) == ("a b", [[1, 81]], 80)


def test_removed_spans_are_cut_from_the_text_itself(spark):
    w = [f"w{i}" for i in range(120)]
    own, line = " ".join(w), "\n\t".join(w[10:90])
    rows = [(1, own + "\n"), (2, f"  a\n\n{line} \n b\n"), (3, "x  y\n"), (4, None), (5, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__chunk", F.lit("kept"))
    got = substring_dedup.substring_dedup(df, layout=True)
    assert {r.doc_id: r.text for r in got.collect()} == {1: own + "\n", 2: "  a\n\nb\n", 3: "x  y\n", 4: None, 5: ""}
    assert got.where("__chunk = 'kept'").count() == 5


def test_words_of_thue_and_morse_differ(spark):
    for n in (1024, 4096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
        (_, _, w), = kernels.word_blocks(pa.array([f"{a} {b} {a}"]), kernels.SPACE)
        assert w.hashes[0] == w.hashes[2] != w.hashes[1]
        words = [x for t in (a, b) for x in t]
        (_, _, w), = kernels.word_blocks(pa.array([" ".join(words)]), kernels.SPACE)
        h, at = kernels.window_hashes(w, n)
        assert h[at.tolist().index(0)] != h[at.tolist().index(n)]
    lead = " ".join(f"v{i}" for i in range(49))
    rows = [(1, f"{lead} {a}"), (2, f"{lead} {b}"), (3, f"{lead} {a}")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 0, 3: 50}


#: Two words with one hash (found by matching sums of four parts of 14 letters).
TWINS = "bbbcbcbcbcbbcbcccbccbbcbcbbcbbbccbbbbbbbccbbbcbbcbbbbcbb", "cbbbcbcbcbbcbcbbbcbbbcbcbbbbbccbbcccbcbbbbcbbbbbbccccbbb"


@pytest.mark.parametrize("chunk", [1 << 23, 300])
def test_equal_hashes_of_other_words_cut_nothing(spark, chunk):
    (_, _, w), = kernels.word_blocks(pa.array([" ".join(TWINS)]), kernels.SPACE)
    assert w.hashes[0] == w.hashes[1] and TWINS[0] != TWINS[1]
    lead, tail = " ".join(f"v{i}" for i in range(30)), " ".join(f"x{i}" for i in range(25))
    rows = [(k, f"{lead}\n {TWINS[k % 3 == 2]}  {tail}") for k in range(1, 13)] + [(20, None), (None, f"{lead} {TWINS[0]} {tail}"), (21, " ".join(f"v{i}" for i in range(30)))]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=chunk)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=repr) == brute_substrings(rows)
    assert {r.doc_id for r in got.where("n_removed = 0").collect()} == {1, 2, 20, 21, None}


@pytest.mark.parametrize("size", [1, 2, 5, 50, 64, 65, 130, 200])
def test_windows_are_told_by_their_words(size):
    rng = random.Random(size)
    words = [rng.choice("abc") if rng.random() < 0.2 else "x" for _ in range(900)]
    words = words[:300] + words[100:400] + words[300:]
    (_, _, w), = kernels.word_blocks(pa.array([" ".join(words)]), kernels.SPACE)
    h, at = kernels.window_hashes(w, size)
    check = kernels.window_checks(w, size)
    told, checked = {}, {}
    for k, first in zip(h.tolist(), at.tolist()):
        told.setdefault(tuple(words[first : first + size]), set()).add(k)
        checked.setdefault(tuple(words[first : first + size]), set()).add(int(check[first]))
    assert all(len(x) == 1 for x in [*told.values(), *checked.values()]) and len(at) == len(words) - size + 1
    assert len({x for y in told.values() for x in y}) == len(told) == len({x for y in checked.values() for x in y})


def test_true_collisions_are_told_apart():
    h, check = np.array([7, 7, 5, 7, 7], np.uint64), np.array([2, 1, 9, 2, 1], np.uint32)
    order, a, b = substring_dedup.by_both(h, check)
    assert order.tolist() == [2, 1, 4, 0, 3] and a.tolist() == [5, 7, 7, 7, 7] and b.tolist() == [9, 1, 1, 2, 2]


def test_ranges_ascend_and_are_bounded(spark):
    from rillstone.llm import ranges

    rng = random.Random(1)
    rows = [(int(rng.random() ** 3 * 10**6) if k % 3 else 7, "x" * rng.randrange(50)) for k in range(5000)] + [(None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    r = ranges.even_ranges(df, "doc_id", F.length("text"), 1000)
    key = F.col("doc_id")
    got = df.select("doc_id", r.coarse(key).alias("c"), r.fine(key, r.coarse(key)).alias("f"), r.upper(r.coarse(key)).alias("top"), F.length("text").alias("n")).collect()
    some = sorted((x for x in got if x.doc_id is not None), key=lambda x: x.doc_id)
    assert all(a.f <= b.f and (a.doc_id != b.doc_id or a.f == b.f) for a, b in zip(some, some[1:])) and {x.f for x in some} <= set(range(r.n)) and r.n > 40
    assert all(x.f is None and x.c is None for x in got if x.doc_id is None)
    assert {x.top for x in some} == {max(y.doc_id for y in some if y.c == x.c) for x in some}
    sizes = {}
    for x in some:
        if x.doc_id != 7:
            sizes[x.f] = sizes.get(x.f, 0) + x.n
    assert max(sizes.values()) < 4000
    plan = lambda n: ranges.id_ranges(spark.range(n).selectExpr("id AS doc_id"), "doc_id", n).coarse(key)
    assert abs(len(str(plan(50)._jc.toString()).split("(")) - len(str(plan(4000)._jc.toString()).split("("))) < 40


def test_packing_round_trips():
    for h in ([], [0], [5, 5, 9], sorted(random.Random(0).getrandbits(64) for _ in range(300))):
        a = np.array(h, np.uint64)
        assert (kernels.unpack_sorted(kernels.pack_sorted(a)) == a).all()


def test_words_and_hashes():
    texts = pa.array(["a  b", None, "", "b\na x", "ÀB b"])
    found = [(i, w) for i, _, w in kernels.word_blocks(texts, kernels.SPACE)]
    w = found[0][1]
    assert [bytes(w.buf[a:b]).decode() for a, b in zip(w.starts, w.ends)] == ["a", "b", "b", "a", "x", "ÀB", "b"] and w.first.tolist() == [0, 2, 2, 2, 5, 7]
    assert w.hashes[0] == w.hashes[3] and w.hashes[1] == w.hashes[2] == w.hashes[6] != w.hashes[0]


# -- license scan


def test_license_scan(spark):
    long = "filler words " * 3000 + "\nReleased under the MIT License."
    rows = [(1, "Released under the MIT License.\nmit  LICENSE, mit-license"), (2, "licensed under CC BY-NC 4.0"), (3, None), (4, ""), (5, "This work is licensed under the GNU General Public License, version 3."), (5, "apache mit license"), (6, "a license"), (7, long), (8, "all rights reserved"), (None, "Apache License")]
    got = {(r.doc_id, r.n_words): r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1))).collect()}
    by = {}
    for r in got.values():
        by.setdefault(r.doc_id, []).append((r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score))
    assert by[1] == [(3, 3, 7, "mit", "mit", 1.0)] and by[2] == [(0, None, None, "", "cc-by-nc", 1.0)]
    assert by[3] == by[4] == [(0, None, None, "", "", 0.0)]
    assert sorted(by[5]) == [(1, 1, 1, "mit", "mit", 1.0), (1, 7, 7, "gpl", "gpl", 1.0)] and by[6] == [(0, None, None, "", "", 0.0)]
    assert by[7] == [(1, 6003, 6003, "mit", "mit", 1.0)] and by[8] == [(0, None, None, "", "reserved", 1.0)] and by[None] == [(1, 0, 0, "apache", "apache", 1.0)]


def brute_matches(text, threshold):
    """(template, label, first word, containment) over all blocks of all templates."""
    words, out = license_scan.text_words(text), set()
    for k, (label, t, keys) in enumerate(license_scan.TEMPLATES):
        size, t = len(license_scan.text_words(t)), set(license_scan.text_words(t))
        for start in range(0, max(1, len(words)), size):
            block = set(words[start : start + 2 * size])
            share = len(t & block) / len(t)
            # the last block of a text adds nothing to the one before that holds all of its words
            if share >= threshold and set(keys.split()) <= block:
                out.add((k, label, start, round(share, 9)))
    return out


def test_license_join_is_exact(spark):
    """Filters lose no match: containment by brute force over random texts and parts of the templates."""
    rng = random.Random(2)
    texts = [license_scan.text_words(t) for _, t, _ in license_scan.TEMPLATES]
    vocab = sorted({w for t in texts for w in t}) + ["other", "words"] * 40
    rows = []
    for i in range(100):
        parts = []
        for _ in range(rng.randint(0, 4)):
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, len(t) // 3)):
                t[rng.randrange(len(t))] = "changed"
            parts += rng.choices(vocab, k=rng.randint(0, 60)) + t
        rows.append((i, "".join(w + rng.choice([" ", "\n", ", "]) for w in parts)))
    for threshold in (0.5, 0.8):
        got = license_scan.license_scan(spark.createDataFrame([*rows, *rows[:2]], "doc_id long, text string"), threshold=threshold).collect()
        assert len(got) == 102
        for r in got:
            assert {(m.t, m.label, m.first_word, round(m.share, 9)) for m in r.matches} == brute_matches(rows[r.doc_id][1], threshold)


def test_license_texts_may_be_wrapped(spark):
    grant = license_scan.TEMPLATES[1][1]
    words = grant.split()
    rows = [(1, "/* " + "\n * ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + " */"), (2, "All rights reserved. Redistribution and use in source and binary forms, with or without modification, is permitted"), (3, "Licensed under CC BY-NC 4.0."), (4, "\u212aelvin MIT Licen\u017fe")]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].labels for k in (1, 2, 3, 4)] == ["mit", "bsd,reserved", "cc-by-nc", ""] and got[4].n_words == 3


# -- fingerprints


def sign_sums(text):
    """The 128 sums of signs by the definition, piece by piece."""
    out = np.zeros(128)
    for k, seed in enumerate((11, 12)):
        start = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), seed=42)
        for piece in re.split(r"\n|(?<=[.,;:!?dgy]) |(?<=[。、，；：！？])", text):
            h = xxhash.xxh64_intdigest(piece.encode(), seed=start)
            out[64 * k : 64 * k + 64] += [1 if h >> b & 1 else -1 for b in range(64)]
    return out


def cosine(a, b):
    size = float(np.sqrt((a @ a) * (b @ b)))
    return min(1.0, max(0.0, float(a @ b) / size)) if size else 0.0


def test_likeness_of_very_long_texts(spark):
    text = "the same line, again\n" * 40_000
    rows = [(2, text), (1, "other, much\nshorter")]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].near_edited > 0.9 > 0.3 > got[2].near_next and got[2].n_chars == len(text)


def test_rows_without_id_follow_themselves(spark):
    rows = [(None, f"text {k}") for k in range(40)] + [(k, f"own {k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1))
    got = fingerprint.with_next(df, {"after": "text"}, tie="text", chunk_bytes=50).collect()
    assert len(got) == 80 and all(r.after == (r.text if r.doc_id is None else f"own {(r.doc_id - 1) % 40}") for r in got)


def test_counts_of_bits_at_the_ends_of_blocks(spark):
    texts = ["\n".join(f"p{k % 50}" for k in range(n)) for n in (1, 6, 7, 8, 14, 15, 100, fingerprint.FEW - 1, fingerprint.FEW, fingerprint.FEW + 8)]
    df = fingerprint.with_vector(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text", "v")
    got = df.withColumn("s", fingerprint.signs("v")).select("k", "v", "s").collect()
    by_lane = [64 * h + b + half for h in range(2) for b in range(32) for half in (0, 32)]
    assert all(r.s == sign_sums(texts[r.k])[by_lane].tolist() and r.v[fingerprint.EQUAL] == texts[r.k].count("\n") + 1 for r in got)


def test_fingerprints_read_few_rows_at_once(spark):
    own = spark.newSession()  # with the reader's usual 4096 rows
    own.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    got = fingerprint.fingerprints(own.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")).count()
    assert got == 2 and int(own.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= kernels.READ_ROWS


def test_fingerprints(docs):
    rows = corpus()
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1] or ""))
    pairs = [(r, order[(k + 1) % len(order)]) for k, r in enumerate(order)] + [(r, r) for r in rows if r[0] is None]
    want = {}
    for r, after in pairs:
        text, nxt = r[1] or "", after[1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + nxt[:n]
        sums = [sign_sums(x) for x in (text, edited, nxt)]
        key = r[0], len(text), hashlib.sha256(edited.encode()).hexdigest()
        want.setdefault(key, []).append([1.0 if x == text else cosine(sums[0], y) for x, y in ((edited, sums[1]), (nxt, sums[2]))])
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        near = want[r.doc_id, r.n_chars, r.edited_sha256]
        assert any(abs(r.near_edited - a) < 1e-9 and abs(r.near_next - b) < 1e-9 for a, b in near)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[0].fingerprint == by[24].fingerprint != by[1].fingerprint
    placed = [r for r in got if r.n_chars > 300 and r.doc_id is not None]  # the others follow themselves
    assert np.mean([r.near_edited for r in placed]) > 0.4 + np.mean([r.near_next for r in placed])


def test_fingerprints_are_homomorphic(spark):
    a, b = ["p one.", "q, two", "q, two"], ["r three", "s"]
    rows = [("\n".join(a + b), "\n".join(a), "\n".join(b), "\n".join(reversed(b + a)))]
    df = spark.createDataFrame(rows, "ab string, a string, b string, ba string")
    for c in ("ab", "a", "b", "ba"):
        df = fingerprint.with_vector(df, c, f"v_{c}")
    r = df.select("v_ab", "v_ba", fingerprint.added("v_a", "v_b").alias("sum"), fingerprint.added("v_ab", "v_b", -1).alias("less"), "v_a").first()
    assert r.v_ab == r.v_ba == r.sum and r.less == r.v_a


# -- search


def test_top_k(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in np.round(base[i % 6] + rng.normal(size=8) * 0.1, 2)]) for i in range(400)]
    rows += [(20, rows[3][1]), (400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (None, rows[0][1]), (420, [0.0] * 8), (440, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    good = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    got = {}
    for r in topk_search.top_k(df, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in {i for i, _ in good if i % 20 == 0}:
        best = sorted((-int(v @ w), i) for qi, w in good if qi == q for i, v in good if i != q and len(v) == len(w))
        many = sum(1 for i, _ in good if i == q)
        if many == 1:
            assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best[:5])]


def test_search_prunes_without_loss():
    rng = np.random.default_rng(1)
    centers = rng.integers(-300, 300, (20, 6))
    data = np.repeat(centers, 400, axis=0) + rng.integers(-3, 4, (8000, 6))
    data, q = data.astype(float), data[::97].astype(float)
    ids, qids = np.arange(8000), np.arange(0, 8000, 97)
    topk_search.LEAF, was = 40, topk_search.LEAF
    try:
        a, b, s = topk_search.search(q, qids, data, ids, 10)
    finally:
        topk_search.LEAF = was
    for k in range(len(q)):
        own = sorted(zip((-s[a == k]).tolist(), b[a == k].tolist()))
        x = data @ q[k]
        x[qids[k]] = -np.inf
        assert own == [(-int(x[i]), int(i)) for i in np.lexsort((ids, -x))[:10]]


def brute_top(rows, k):
    """By query, (rank, id, score) of the best with Python's whole numbers."""
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in good if i != q and len(v) == len(w))
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best[:k])]
    return out


def found_top(spark, rows, k, **settings):
    got = {}
    for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=k, **settings).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def test_cells_are_pruned_without_loss(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CELL_ROWS", 40)
    monkeypatch.setattr(topk_search, "DATA_BLOCK", 50)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 6)) * 5
    rows = [(i, (centers[i % 12] + rng.normal(size=6) * 0.05).tolist()) for i in range(900)] + [(2000 + i, [1.0, 2.0]) for i in range(3)]
    report = []
    assert found_top(spark, rows, 5, report=report) == brute_top(rows, 5)
    every, searched = report[0]
    assert searched < every / 2


def test_scores_of_any_size(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10 ** rng.integers(0, 8)]) for i in range(130)] + [(200, [1e6] * 4), (201, [-1e6] * 4), (220, [0.0] * 4)]
    assert found_top(spark, rows, 7) == brute_top(rows, 7)
    a, b = rng.integers(-(1 << 40), 1 << 40, (5, 3)), rng.integers(-(1 << 20), 1 << 20, (4, 3))
    assert topk_search.products(a.astype(float), b.astype(float)).tolist() == (a.astype(object) @ b.T.astype(object)).tolist()


# -- near-dedup


def near_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(12):
        base = prose(rng, rng.randint(60, 200)).split()
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "zz" + str(rng.randint(0, 99))
            rows.append(" ".join(w))
    passage = prose(rng, 60)
    rows += [passage + " " + prose(rng, 60) for _ in range(10)] + ["", "", " ", "two words", "two words", None, rows[0]]
    return list(enumerate(rows))


@pytest.mark.parametrize("group", [2000, 3])
def test_near_dedup(spark, group, monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP", group)
    rows = near_rows()
    df = spark.createDataFrame([*rows, rows[1], (None, rows[0][1])], "doc_id long, text string").withColumn("node", F.lit(0)).repartition(4)
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) + 2
    cls = {r.doc_id: r.class_id for r in got}
    # the same definition by brute force over all pairs
    texts = pa.array([t for _, t in rows])
    idf = near_dedup.inverse_frequencies(df, "text")
    sets = []
    for _, _, w in kernels.word_blocks(texts, kernels.SPACE):
        h, weight, first = near_dedup.shingles(w, idf)
        sets += [(h[a:b], weight[a:b]) for a, b in zip(first[:-1], first[1:])]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a is not None and b is not None and (a == b or len(sets[i][0]) and near_dedup.similarity(sets[i], sets[j]) >= 0.8):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert {i: cls[i] for i, _ in rows} == {i: find(i) for i, _ in rows}
    kept = near_dedup.keep_one(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and sorted(i for i in ids if i is not None) == sorted(set(cls[i] for i, _ in rows)) and ids.count(None) == 1


def edited_copies(n, edits, seed):
    """Copies of one text, each with some words changed of the text or of an earlier copy."""
    rng = random.Random(seed)
    copies = [prose(rng, 200).split()]
    for k in range(n):
        w = list(copies[rng.randrange(len(copies)) if rng.random() < 0.3 else 0])
        for _ in range(rng.randint(*edits)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 999)}"
        copies.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(copies[1:])]


def brute_classes(df, rows):
    """By id, the least id of its class, from all pairs; and the similarities."""
    idf, sets = near_dedup.inverse_frequencies(df, "text"), []
    for _, _, w in kernels.word_blocks(pa.array([t for _, t in rows]), kernels.SPACE):
        h, weight, first = near_dedup.shingles(w, idf)
        sets += [(h[a:b], weight[a:b]) for a, b in zip(first[:-1], first[1:])]
    cls, like = list(range(len(rows))), []
    for i in range(len(rows)):
        for j in range(i):
            like.append(near_dedup.similarity(sets[i], sets[j]))
            if like[-1] >= 0.8 and cls[i] != cls[j]:
                low, high = sorted((cls[i], cls[j]))
                cls = [low if c == high else c for c in cls]
    return dict(enumerate(cls)), like


@pytest.mark.parametrize("seed", [1, 3])
def test_links_are_sought_beyond_the_first_forest(spark, seed):
    rows = edited_copies(120, (1, 5), seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, like = brute_classes(df, rows)
    assert np.mean([0.7 <= x < 0.8 for x in like]) > 0.1 and 1 < len(set(want.values())) < 100
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == want


@pytest.mark.parametrize("seed", [1])
def test_large_keys_lose_no_links(spark, seed, monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP", 20)
    rows = edited_copies(150, (1, 6), seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute_classes(df, rows)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == want


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    w = rng.uniform(0.5, 3, 3000).astype(np.float32)
    a, b = np.sort(h[:2500]), np.sort(h[500:])
    weights = dict(zip(h.tolist(), w.tolist()))
    wa, wb = (np.array([weights[x] for x in y.tolist()], np.float32) for y in (a, b))
    wb = wb * np.float32(1.3)
    true = near_dedup.similarity((a, wa), (b, wb))
    s = near_dedup.Sampler(2000)
    got = (s.samples(a, wa, np.array([0, len(a)])) == s.samples(b, wb, np.array([0, len(b)]))).mean()
    assert abs(got - true) < 0.05


# -- language, toxicity, mixing

LETTERS = {"aa": "the and of with that have from", "bb": "der und die das ist nicht mit", "cc": "les des une que dans pour avec"}


def labelled(n=240, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(list(LETTERS))
        words = rng.choices(LETTERS[lang].split(), k=rng.randint(20, 60))
        toxic = rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["blorg", "blorgish", "snarf"])
        quality = int(rng.random() < 0.6)
        text = " ".join(words) if quality else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, lang, "s", len(text)))
        labels.append((i, quality, int(toxic)))
    docs += [(n, None, "aa", None, None), (n + 1, "", None, None, None), (n + 2, "123 !?", "bb", None, None), (None, "the and", None, None, None), docs[0]]
    return docs, labels


def test_language(spark):
    docs, _ = labelled()
    got = lang_id.identify(spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("x"))).collect()
    truth = {d[0]: d[2] for d in docs}
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and held and all(r.lang_pred == truth[r.doc_id] for r in held if r.doc_id is not None and r.doc_id < 240)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id is not None and r.doc_id >= 240}
    assert set(odd.values()) == {("und", 0.0)}
    assert lang_id.identify(empty(spark)).collect() == []


def test_language_table_is_the_cosine():
    texts = pa.array(["there and here", "und der das", "q"])
    row, code, _ = lang_id.triples(texts)
    protos = {"x": (np.unique(code[row == 0], return_counts=True)), "y": (np.unique(code[row == 1], return_counts=True))}
    m = lang_id.bundle(protos)
    v = [lang_id.bound(code[row == k]).astype(float).sum(axis=0) for k in range(3)]
    for k, name in enumerate(m.languages):
        p = (protos[name][1][:, None] * lang_id.bound(protos[name][0])).sum(axis=0)
        for d in range(2):
            assert math.isclose(float(m.table[k][code[row == d]].sum()) / np.linalg.norm(v[d]), float(v[d] @ p) / np.linalg.norm(v[d]) / np.linalg.norm(p), rel_tol=1e-3)


def test_toxicity(spark):
    docs, labels = labelled()
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(spark.createDataFrame(docs, DOCS), lab).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(docs) and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = toxicity.score_toxicity(spark.createDataFrame(docs, DOCS), lab.where("false")).collect()
    assert {r.score for r in none} == {0.0} and toxicity.score_toxicity(empty(spark), lab).count() == 0


def test_pooling_in_spans(monkeypatch):
    net = toxicity.Net.new(np.random.default_rng(1))
    ids = np.random.default_rng(2).integers(0, 1 << 16, (1000, 3))
    whole = net.pooled(ids, np.array([0, 1000]))
    for span in (999, 998, 100, 7):
        monkeypatch.setattr(toxicity, "SPAN", span)
        assert np.allclose(net.pooled(ids, np.array([0, 1000])), whole, atol=1e-6)


def test_gradient_of_the_net():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 1 << 16, (n, 3)) for n in (1, 2, 5, 0, 9)]
    net = toxicity.fit(texts, np.array([1, 0, 1, 0, 0], np.float32), epochs=1)
    first = np.cumsum([0, *map(len, texts)])
    ids = np.concatenate(texts)
    pool = net.pooled(ids, first)
    for d, t in enumerate(texts):  # windows by hand
        x = net.emb[t].sum(axis=1)
        for k, (width, w, b) in enumerate(zip(toxicity.WIDTHS, net.conv, net.bias)):
            acts = [np.maximum(sum(x[i + o] @ w[o] for o in range(width)) + b, 0) for i in range(len(t) - width + 1)]
            want = np.max(acts, axis=0) if acts else np.zeros(toxicity.FILTERS)
            assert np.allclose(pool[d, k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS], want, atol=1e-4)


def test_mixing_meets_targets(spark):
    docs, labels = labelled()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    target = {"fine": 0.5, "poor": 0.4, "toxic": 0.1}
    df = spark.createDataFrame(docs, DOCS).withColumn("rate", F.lit("clash"))
    got = mixing.mix(df, lab, targets=target).collect()
    total = sum(r.n_tokens for r in got)
    # the rates solve the least-squares problem: no document's rate can change for the better
    miss = np.array([sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) / total - share for d, share in target.items()])
    for r in got:
        gradient = np.array([r.p_fine, r.p_poor, r.p_toxic]) @ miss
        assert abs(min(r.rate, gradient)) < 5e-3
    assert np.abs(miss).max() < 0.05
    assert all(r.rate >= 0 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) and abs(r.p_fine + r.p_poor + r.p_toxic - 1) < 1e-9 for r in got) and len(got) == len(docs)
    assert mixing.mix(empty(spark), lab).count() == 0
    flat = mixing.mix(df, lab.where("false"), targets=target).first()
    assert math.isclose(flat.p_fine, 1 / 3)
    again = mixing.resample(df.drop("rate"), lab, targets=target)
    assert again.columns == df.drop("rate").columns and again.count() == sum(r.copies for r in got)


def active_set_optimum(a, target, weight):
    """The residual of min |a r - target|, r >= 0, by Lawson and Hanson's active sets: an independent solver."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    while True:
        w = a.T @ (target - a @ x) / weight
        if free.all() or w[~free].max() < 1e-12:
            return a @ x - target
        free[np.argmax(np.where(free, -np.inf, w))] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], target, rcond=None)[0]
            if s[free].min() > 0:
                break
            at = free & (s <= 0)
            x = x + (x[at] / (x[at] - s[at])).min() * (s - x)
            free &= x > 1e-15
        x = s


@pytest.mark.parametrize("target", [(0.9, 0.1, 0.0), (3.0, 0.0, 0.0), (0.0, 0.0, 0.0)])
def test_rates_solve_the_least_squares_problem(spark, target):
    """Also where nonnegativity binds and where no rates reach the targets."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet([1, 1, 1], 60)
    n = rng.integers(1, 50, 60)
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    fit = mixing.fit_rates(table, dict(zip(mixing.DOMAINS, target)))
    r, _ = mixing.replay(p, fit.steps)
    w = n / n.sum()
    a = (p * w[:, None]).T
    miss = a @ r - target
    assert np.allclose(miss, fit.miss, atol=1e-9) and (r >= 0).all() and 0 < fit.rounds < 100
    assert np.allclose(miss, active_set_optimum(a, np.array(target), w), atol=1e-4)
    grad = p @ miss
    assert np.sqrt(w @ np.where(r > 0, grad, np.minimum(grad, 0)) ** 2) < 2e-6


def test_mixing_relative_to_measured_shares(spark):
    docs, labels = labelled()
    df, lab = spark.createDataFrame([*docs, (None, "a text without id", "en", "s", 17), (None, "another one", "en", "s", 11)], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    report = []
    got = mixing.mix(df, lab, targets=None, factors={"fine": 1.2}, report=report).collect()
    total = sum(r.n_tokens for r in got)
    share = {d: sum(r.n_tokens * r[f"p_{d}"] for r in got) / total for d in mixing.DOMAINS}
    for d, k in (("fine", 1.2), ("poor", 1.0), ("toxic", 1.0)):
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) / total - k * share[d]) < 1e-5
    assert report[0].rounds > 0 and np.abs(report[0].miss).max() < 1e-5 and len(got) == len(docs) + 2


# -- HTML

PAGES = {
    "<html><head><title>T</title></head><body><nav><a>Home</a></nav><article><h1>Big &amp; small</h1><p>First <b>para</b>graph,   with text.<p>Second one &lt;x&gt;, unclosed.</article><footer>&copy; me</footer></body></html>": "Big & small\nFirst paragraph, with text.\nSecond one <x>, unclosed.",
    "<body><div id='main'><div class='sidebar'>links, links. and links</div><p>The text, of the page. It goes on, and on.</p><ul><li>one</li><li>two</li></ul></div><div class=\"cookie-notice\">We use cookies, accept.</div><form><input value=x>Search</form><div id=comments><p>Great post, really. Thanks!</p></div></body>": "The text, of the page. It goes on, and on.\none\ntwo",
    "<main><script>if (a < b) document.write('<p>no, no.</p>')</script><p>Yes, here.<br>And there.</p></main><style>p{}</style>": "Yes, here. And there.",
    "": "", None: "", "plain text only, without tags.": "plain text only, without tags.", "<article><p>cut off, in the mid &am": "cut off, in the mid &am", "<article><p>cut, in a tag <a href=\"x": "cut, in a tag", "<nav>menu</nav>": "",
}


def test_html(spark):
    rows = [(i, h) for i, h in enumerate(PAGES)] + [(0, next(iter(PAGES)))]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1))).collect()
    for r in got:
        assert r.text == PAGES[r.html] and r.n_chars == len(r.text)
    long = "<article>" + "".join(f"<p>Paragraph {i}, with some words.</p>" for i in range(20000)) + "</article>"
    assert html_text.main_text(long) == "\n".join(f"Paragraph {i}, with some words." for i in range(20000))


# -- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def all_ways(v, word):
    edges = v.edges(word)

    def back(at):
        if not at:
            yield 0.0, ()
        for i, ids, s in edges[at]:
            for a, b in back(i):
                yield a + s, b + ids[::-1]

    return sorted(back(len(word)), key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the thing", "an of\nit", "é▁x 日", "a  b ", "x"])
def test_nbest_by_enumeration(vocabulary, text):
    want = all_ways(vocabulary, " " + text)
    encoder = pieces.Encoder(vocabulary, 6)
    ids, ends, ways, good = encoder.block(pa.array(["", text, None, text]))
    assert ways[1] == ways[3] and ways[0] == ways[2] == [(0.0, 0, hashlib.sha256().hexdigest())] and good.all()
    assert vocabulary.decode(ids[ends[1] : ends[2]].tolist()) == text
    got = ways[1]
    assert [round(s, 6) for s, _, _ in got] == [round(s, 6) for s, _ in want[:6]]
    known = {(round(s, 6), len(ids), hashlib.sha256(pieces.packed(ids)).hexdigest()) for s, ids in want}
    assert set((round(s, 6), n, x) for s, n, x in got) <= known and len({x for _, _, x in got}) == len(got)


def test_words_together_and_one_by_one(vocabulary):
    rng = random.Random(2)
    alphabet = "abcdeorst  é日\U0001f600\0▁\n."
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 14))) for _ in range(3000)} | {"a", " ", "\0"})
    flat, count, score, loss = vocabulary.lattice.best([w.encode() for w in words])
    ends = np.cumsum(count)
    for k, w in enumerate(words):
        top, path, lost = vocabulary.best_and_loss(w)
        assert [i for part in path for i in part][::-1] == flat[ends[k] - count[k] : ends[k]].tolist()
        assert score[k] == top and (loss[k] == lost or min(loss[k], lost) > 1e290)
    assert vocabulary.decodes_to(flat, count, [w.encode() for w in words]).all()
    assert not vocabulary.decodes_to(np.roll(flat, 1), count, [w.encode() for w in words]).all()


def test_words_are_cut_as_stated(vocabulary):
    texts = ["a b", "  a  \n\n b\nc ", "\n", " ", "\u2581é x", "", "ab\n", "x\n y"]
    words, first = pieces.Encoder(vocabulary, 1).words(pa.array(texts))
    assert vocabulary.cut and vocabulary.lines
    for k, text in enumerate(texts):
        want = re.findall(r"\n| *[^ \n]+| +", " " + text) if text else []
        assert [w.decode() for w in words.to_pylist()[first[k] : first[k + 1]]] == want


def test_long_unspaced_texts(vocabulary):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(100_000)), "a" * 30_000, "日本" * 5000]
    encoder = pieces.Encoder(vocabulary, 3)
    ids, ends, ways, good = encoder.block(pa.array(texts))
    assert good.all() and [len(w) for w in ways] == [3, 3, 1] and all(w[0][0] >= w[1][0] >= w[2][0] and len({x for _, _, x in w}) == 3 for w in ways[:2])
    assert [vocabulary.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])] == texts


def test_known_words_are_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    small, large = pieces.Encoder(vocabulary, 2), pieces.Encoder(vocabulary, 2)
    texts = [f"some words {k} and {k * k}" for k in range(50)]
    want = large.block(pa.array(texts))[2]
    assert [small.block(pa.array([t]))[2][0] for t in texts] == want and len(small.known) < 12


def test_round_trip(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash"))
    got = pieces.encode(df, nbest=3)
    rows_out = got.collect()
    assert len(rows_out) == len(rows) and all(r.round_trip and len(r.ids) == r.n_tokens and r.nbest[0].score == r.score for r in rows_out)
    assert all(r.nbest[k].score >= r.nbest[k + 1].score for r in rows_out for k in range(len(r.nbest) - 1))
    back = {(r.doc_id, r.n_tokens): r.text for r in pieces.decode(got.select("doc_id", "ids", "n_tokens")).collect()}
    assert all(back[r.doc_id, r.n_tokens] == (r.text or "") for r in rows_out if r.doc_id not in (3, None))
    assert pieces.encode(empty(spark)).count() == 0


def test_empty_tables(spark):
    e = empty(spark)
    for f in (substring_dedup.substring_dedup, license_scan.license_scan, fingerprint.fingerprints, near_dedup.near_duplicates, near_dedup.keep_one):
        assert f(e).count() == 0, f
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_unescapes_once():
    assert html_text.main_text("<article><p>a &amp;lt; b, c.</p></article>") == html.unescape("a &amp;lt; b, c.")
