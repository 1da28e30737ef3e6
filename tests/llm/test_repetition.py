"""Collocations, shared lines, periodic runs and perfect hashes against plain versions, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavecrest.llm import catalog, lines, perfect_hash, phrases, runs
from wavecrest.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, a long, h long, lines string, runs string, phrase string, number long"
TEXTS = [
    None, "", "\n", " \t\x0b\n\x0c\r", "one two three. one two three! One TWO three", "ab\n  AB \n\tab\x0b\nAb é", "ab\nÉ", "x " * 60, "a b " * 30 + "c", "été là\x1cx\x85y " * 9,
    "\n".join(["same line", "Same Line ", "other"] * 20), "w" * 3000 + " " + "very long text. " * 3000, "a:b;c,d.e?f!g\x0bh\x0ci\rj\nk l\tm",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "d e"][i % 3], "s", i, i, "x", "y", "z", i) for i, t in enumerate(TEXTS)]
    rows += [(4, TEXTS[4], "en", "s", 0, 0, "", "", "", 0), (None, TEXTS[5], "en", None, None, None, None, None, None, None), (99, "ab\nshort", "en", "s", 1, 1, "", "", "", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# perfect hashes


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.integers(0, 2**64 - 1))
@settings(max_examples=60, deadline=None)
def test_perfect_hash_numbers_each_key_once(keys, other):
    keys = np.array(sorted(keys), np.uint64)
    found = perfect_hash.PerfectHash.build(keys)
    assert sorted(found.slots(keys).tolist()) == list(range(len(keys)))
    assert -1 <= found.slots(np.array([other], np.uint64))[0] < max(1, len(keys))


def test_perfect_hash_refuses_equal_keys():
    with pytest.raises(ValueError, match="repeat"):
        perfect_hash.PerfectHash.build(np.array([5, 5], np.uint64))


def test_index_of_many_shards_finds_its_keys_alone(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"), F.col("id").alias("v"))
    index = perfect_hash.build_index(rows, "index", 300)
    assert len(index.files) == 17 and index.size == 5000
    known = {r.h & 2**64 - 1: r.v for r in rows.collect()}
    keys = np.array([*known, 1, 2**63], np.uint64)
    number = index.find(keys)
    assert sorted(number[:-2].tolist()) == list(range(5000)) and number[-2:].tolist() == [-1, -1]
    assert index.read(number[:-2], ["v"]).column("v").to_pylist() == list(known.values())
    first = perfect_hash.index_rows(spark, index, lambda first, shard: shard.rows.select(["h", "v"]), "h long, v long")
    assert {r.h & 2**64 - 1: r.v for r in first.collect()} == known


def test_index_of_nothing_finds_nothing(spark):
    index = perfect_hash.build_index(spark.createDataFrame([], "h long, v long"), "index")
    assert index.size == 0 and index.find(np.array([1], np.uint64)).tolist() == [-1]


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_counts_read_back(counts):
    assert perfect_hash.unpack(perfect_hash.pack(np.array(counts, np.uint64))).tolist() == counts


def test_tree_sum_adds_parts(spark):
    rows = [(k % 3, p, perfect_hash.pack(np.array([k, p, 1], np.uint64))) for k in range(3) for p in range(200)]
    got = {r.shard: perfect_hash.unpack(r.counts).tolist() for r in perfect_hash.tree_sum(spark.createDataFrame(rows, perfect_hash.ARRAYS)).collect()}
    assert got == {k: [200 * k, sum(range(200)), 200] for k in range(3)}


# collocations


def plain_collocations(rows, longest=5, least=100, share=100, first=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= share * a for q, b in frequent.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(rows[:first])]
    return sorted(out)


FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_collocations_equal_a_plain_count(spark, docs):
    rows = [(r.text, r.lang) for r in docs.collect()]
    for longest, least, share, first in [(5, 2, 100, 2000), (3, 3, 60, 4), (2, 1, 100, 2000)]:
        if least == 1:
            rows = rows[4:7]
        got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), longest=longest, least=least, share=share, first=first)
        assert sorted(tuple(r[c] for c in FIELDS) for r in got.collect()) == plain_collocations(rows, longest, least, share, first)


def test_collocations_of_small_blocks_and_many_ties(spark):
    words = ["a", "b", "the", "é", "x"]
    rng = np.random.default_rng(1)
    rows = [(" ".join(rng.choice(words, 30)) + rng.choice([".", "", "!"]), ["en", "fr"][i % 2]) for i in range(40)]
    found, totals = phrases.frequent_phrases(spark.createDataFrame(rows, "text string, lang string").repartition(3), least=5, block_bytes=100, held_bytes=150)
    kept = {(r.lang, r.phrase): (r.a, r.lefts, r.rights) for r in found.collect()}
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.!]", text):
            w = piece.split()
            for m in range(1, 6):
                counts[lang].update(" ".join(w[i : i + m]) for i in range(len(w) - m + 1))
    want = {}
    for lang, c in counts.items():
        for p, a in c.items():
            w = p.split()
            if a >= 5 and len(w) > 1:
                want[lang, p] = (a, [c[" ".join(w[:k])] for k in range(1, len(w))], [c[" ".join(w[k:])] for k in range(1, len(w))])
    assert kept == want
    assert {r.lang: r.n for r in totals.collect()} == {"en": 600, "fr": 600}


def test_collocations_beyond_64_bits(spark):
    n = 3_100_000_000_000
    top = spark.range(1).select((F.lit(1000).cast("decimal(38,0)") * F.lit(n).cast("decimal(38,0)") * F.lit(n).cast("decimal(38,0)")).alias("t"))
    assert top.selectExpr(f"t div (cast({n} as decimal(38,0)) * cast({n - 1} as decimal(38,0))) s").first()[0] == 1000 * n * n // (n * (n - 1))


def test_collocations_of_nothing(spark, none):
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en"), ("a b", "en")], "text string, lang string")).count() == 0


# lines


def plain_lines(rows, least=10, points=1):
    def key(line):
        return lower(re.sub("^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$", "", line))

    split = [(i, (t or "").split("\n")) for i, t in rows]
    found = Counter(k for _, ls in split for k in {key(x) for x in ls} if len(k) >= points)
    common = {k for k, n in found.items() if n >= least}
    return sorted(((i, len(ls), sum(key(x) in common for x in ls), "\n".join(x for x in ls if key(x) not in common)) for i, ls in split), key=str)


@pytest.mark.parametrize(("least", "points"), [(10, 1), (2, 1), (3, 3), (1, 0), (1, 4)])
def test_lines_equal_a_plain_count(docs, least, points):
    got = lines.drop_common_lines(docs, least_documents=least, least_points=points)
    assert got.columns == [*[c for c in docs.columns if c != "lines"], "lines"]
    shown = sorted(((r.doc_id, r.lines.n_lines, r.lines.n_dropped, r.lines.kept) for r in got.collect()), key=str)
    want = plain_lines([(r.doc_id, r.text) for r in docs.collect()], least, points)
    assert shown == want


@given(st.lists(st.text("ab \t\nÉA\x0b", max_size=12), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_line_spans_and_keys(texts):
    import pyarrow as pa

    from wavecrest.llm.common import utf8

    text = utf8(pa.array(texts), lower=False)
    starts, ends, first = lines.line_keys(text)
    data = text.data.tobytes()
    cut = [[data[a:b].decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert cut == [t.split("\n") for t in texts]
    size, h = lines.line_hashes(text, starts, ends)
    keys = [lower(x.strip(" \t\n\x0b\x0c\r")) for t in texts for x in t.split("\n")]
    assert size.tolist() == [len(k.encode()) for k in keys]
    same = {}
    for k, x in zip(keys, map(tuple, h.tolist()), strict=True):
        assert same.setdefault(k, x) == x
    assert len(set(same.values())) == len(same)


def test_lines_of_nothing(none):
    assert lines.drop_common_lines(none).count() == 0


def test_a_line_of_every_document_goes_and_clean_ones_stay(spark):
    rows = [(i, f"Subscribe now \nown line {i}\n\tSUBSCRIBE NOW") for i in range(500)] + [(500, "clean\n\ntext")]
    got = {r.doc_id: r.lines for r in lines.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert all(got[i].kept == f"own line {i}" and got[i].n_dropped == 2 and got[i].most_documents == 500 for i in range(500))
    assert got[500].kept == "clean\n\ntext" and got[500].most_documents == 0


# runs


def plain_runs(w, least=24, periods=3):
    out, n = [], len(w)
    for p in range(1, n // periods + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i < n - p and w[i] == w[i + p]:
                i += 1
            part = w[s : i + p]
            if len(part) >= max(least, periods * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                out.append((s, len(part), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def found_runs(texts, least=24, periods=3):
    codes = {}
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    x, ends = [], []
    for i in order:
        x += [codes.setdefault(v, len(codes)) for v in texts[i]] + [10**6 + i]
        ends.append(len(x))
    out = [[] for _ in texts]
    for s, n, p in runs.word_runs(np.array(x, np.int32), np.array(ends), least, periods):
        k = int(np.searchsorted(ends, s, "right"))
        out[order[k]].append((s - (ends[k] - len(texts[order[k]]) - 1), n, p))
    return [sorted(r, key=lambda t: (t[0], t[2])) for r in out]


@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 9)), max_size=6), min_size=1, max_size=4), st.sampled_from([24, 6, 1]))
@settings(max_examples=300, deadline=None)
def test_runs_equal_all_periods_tried(parts, least):
    texts = [[x for block, times in text for x in block * times] for text in parts]
    assert found_runs(texts, least) == [plain_runs(t, least) for t in texts]


@given(st.integers(0, 10**6))
@settings(max_examples=100, deadline=None)
def test_runs_of_words_that_hardly_differ(seed):
    rng = np.random.default_rng(seed)
    texts = [np.where(rng.random(n) < 0.03, 1, np.resize(rng.integers(0, 2, p), n)).tolist() for n, p in zip(rng.integers(1, 160, 3), rng.integers(1, 9, 3), strict=True)]
    assert found_runs(texts) == [plain_runs(t) for t in texts]


def plain_row(doc_id, text, plant):
    w = re.findall("[^ \t\n\x0b\x0c\r]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    own = plain_runs(w)
    gone = {k for s, m, q in own for k in range(s + q, s + m)}
    best = min(own, key=lambda r: (-r[1] / r[2], r[0], r[2])) if own else (None, None, None)
    shown = "".join(f"{s},{m},{q}\n" for s, m, q in own)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (doc_id, len(own), *best, 1000 * best[1] // best[2] if own else None, hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_op13_equals_all_periods_tried(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").where("length(text) < 6000").collect()
    want = {r.doc_id: plain_row(r.doc_id, r.text, True) for r in rows}
    got = {r.doc_id: tuple(r) for r in catalog.op13_runs(spark, sf_dir).collect()}
    assert len(want) > 150 and {k: got[k] for k in want} == want
    assert sum(v[1] > 0 for v in want.values()) > 5


def test_op13_leaves_rows_in_full(spark, sf_dir):
    assert catalog.op13_runs(spark, sf_dir).count() == table(spark, sf_dir, "documents").count()


def test_runs_of_awkward_rows(docs, none):
    got = runs.periodic_runs(docs)
    assert got.columns == [*[c for c in docs.columns if c != "runs"], "runs"]
    small = got.where("text is null or length(text) < 2000")
    for r in small.select("doc_id", "text", "runs").collect():
        w = re.findall("[^ \t\n\x0b\x0c\r]+", r.text or "")
        own = plain_runs(w)
        gone = {k for s, m, q in own for k in range(s + q, s + m)}
        assert (r.runs.n_words, [tuple(x) for x in r.runs.runs], r.runs.collapsed) == (len(w), own, " ".join(x for k, x in enumerate(w) if k not in gone))
    long = got.where("doc_id = 11").first().runs
    assert [tuple(x) for x in long.runs] == [(1, 9000, 3)] and long.collapsed == "w" * 3000 + " very long text."
    assert runs.periodic_runs(none).count() == 0


def test_best_run_takes_the_first_of_equal_shares(spark):
    rows = [([(0, 30, 5), (3, 24, 4), (9, 60, 10)],), ([],), ([(0, 31, 5), (3, 24, 4)],), ([(0, 24, 8), (0, 30, 10), (7, 25, 8)],)]
    df = spark.createDataFrame(rows, "r array<struct<start:long,length:long,period:long>>").select(runs.best_run(F.col("r")).alias("b"))
    assert [r.b and tuple(r.b) for r in df.collect()] == [(0, 30, 5), None, (0, 31, 5), (7, 25, 8)]


def test_runs_need_three_periods():
    with pytest.raises(ValueError, match="three"):
        runs.word_runs(np.arange(4), np.array([4]), 1, 2)
