"""Each corpus operator against a plain version of itself, on test data and on awkward rows."""

import hashlib
import json
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wavecrest.llm import catalog, chat, decontaminate, huffman, language, lm, media, packing, shingles, simhash, tokens, toxicity, warc
from wavecrest.llm.common import mix, range_hashes, table, utf8, words
from wavecrest.llm.components import connected_components

LONG = "The and of a thing. " * 4000
TEXTS = ["The and of a thing one two three four five six seven", "the AND of a thing one two three four five six seven", None, "", " \n\t ", "x", "Éa É́b ǅ <|endoftext|> don't ... 12, 3.4 a.b !!", LONG, LONG, "one two three four five six seven eight nine ten eleven", "été là-bas\x00\x00"]
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, n_hit int, score double, hit_words string, contamination string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else "s", i, i, 0.5, "x", "y") for i, t in enumerate(TEXTS)]
    rows += [(3, "", "fr", "s", 0, 0, 0.0, "", ""), (None, "of a thing", "fr", "s", None, None, None, None, None), (9, TEXTS[9], "en", "s", 1, 1, 1.0, "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain_contamination(text, items, width=10):
    own, hit, found = plain_words(text), set(), set()
    for item, t in items:
        w = plain_words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for a in range(len(own) - n + 1):
                if own[a : a + n] == w[k : k + n]:
                    hit.update(range(a, a + n))
                    found.add("null" if item is None else str(item))
    names = sorted(found)
    return len(own), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


ITEMS = [(2, "of a thing"), (10, "Two, three: four-five SIX seven eight nine ten eleven twelve"), (None, "été"), (4, None), (5, ""), (2, "of a thing"), (7, "one two three four five six seven eight nine ten"), (11, "is")]


@pytest.mark.parametrize("slice_bytes,held_bytes", [(1 << 20, 1 << 26), (40, 1 << 26), (1, 1000)])
def test_contamination_of_awkward_rows(spark, docs, slice_bytes, held_bytes):
    items = ITEMS + [(100 + k, f"slice{k} of a thing one{k}") for k in range(50 if slice_bytes == 1 else 0)]
    found = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), slice_bytes=slice_bytes, held_bytes=held_bytes)
    assert found.columns == SCHEMA.replace(",", "").split()[::2]
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for r in found.collect():
        c = r.contamination
        assert (c.n_words, c.n_hit, c.n_items, c.items_sha256, c.contaminated) == plain_contamination(r.text, items), r.doc_id


def test_contamination_without_rows(spark, docs, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contamination.contaminated for r in decontaminate.find_contamination(docs, items).collect())
    assert decontaminate.find_contamination(none, items).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=9), min_size=1, max_size=12, unique=True), st.text("ab ", max_size=300))
def test_wu_manber_finds_every_occurrence(patterns, text):
    got = decontaminate.WuManber([p.encode() for p in patterns]).search(np.frombuffer(text.encode(), np.uint8), lane=16)
    want = [(a, k) for k, p in enumerate(patterns) for a in range(len(text)) if text.startswith(p, a)]
    assert sorted(zip(got[0].tolist(), got[1].tolist(), strict=True)) == sorted(want)


def plain_best_fit(lengths, sources, clusters, capacity, per_source):
    bins = []
    out = []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fit = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= n and b["room"] and c not in b["clusters"] and b["sources"].count(s) < per_source]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append({"room": capacity, "clusters": set(), "sources": []})
        out.append((i, capacity - bins[i]["room"]))
        bins[i]["room"] -= n
        bins[i]["clusters"].add(c)
        bins[i]["sources"].append(s)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 3), st.integers(0, 5)), max_size=60), st.integers(1, 3))
def test_packing_is_best_fit(rows, per_source):
    rows = sorted(rows, key=lambda r: -r[0])
    args = [list(x) for x in zip(*rows, strict=True)] if rows else [[], [], []]
    assert packing.pack(*args, 20, per_source) == plain_best_fit(*args, 20, per_source)


def test_packed_bins_hold_no_conflict(spark, docs, none, sf_dir):
    def check(source, capacity):
        own = source.select("doc_id", packing.text_tokens().alias("n"), "source", packing.text_cluster().alias("cluster")).toPandas()
        got = packing.pack_documents(source, packing.text_tokens(), F.col("source"), packing.text_cluster(), capacity=capacity, shard_rows=100).toPandas()
        assert got["piece_tokens"].sum() == own["n"].sum()
        assert (got.groupby(["shard", "bin"])["piece_tokens"].sum() <= capacity).all()
        return own, got

    own, got = check(table(spark, sf_dir, "documents"), 512)
    assert (got.groupby("doc_id")["piece_tokens"].sum().sort_index().to_numpy() == own.set_index("doc_id")["n"].sort_index().to_numpy()).all()
    both = got[got["piece_tokens"] < 512].merge(own, on="doc_id")
    assert not both.duplicated(["shard", "bin", "cluster"]).any()
    assert (both.groupby(["shard", "bin", "source"]).size() <= 2).all()
    ends = got.sort_values(["shard", "bin", "bin_start"])
    assert (ends.groupby(["shard", "bin"])["bin_start"].first() == 0).all()
    check(docs, 64)
    assert packing.pack_documents(none, packing.text_tokens(), F.col("source"), packing.text_cluster()).count() == 0


def test_packing_keeps_large_ids_and_deals_equal_rows(spark):
    rows = [((1 << 53) + 1, 7, "s", "a"), (None, 7, "s", "a"), (7, 900, None, None)] + [(3, 5, "s", "b")] * 3000
    source = spark.createDataFrame(rows, "doc_id long, n long, s string, c string")
    got = packing.pack_documents(source, F.col("n"), F.col("s"), F.col("c"), shard_rows=100).toArrow()
    ids = got.column("doc_id").to_pylist()
    assert sorted(ids, key=str) == sorted([r[0] for r in rows], key=str)
    sizes = pd.Series(got.column("shard").to_numpy()).value_counts()
    assert sizes.max() < 200
    one = packing.pack_documents(source, F.col("n"), F.col("s"), F.col("c"), shard_rows=100)
    two = packing.pack_documents(source.repartition(5, F.rand(1)), F.col("n"), F.col("s"), F.col("c"), shard_rows=100)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)


def test_media_round_trip(spark, docs, none):
    got = media.media_column(docs).toPandas()
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    cols = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]
    assert sorted(want, key=str) == sorted(((None if pd.isna(a) else int(a), *b) for a, *b in got[cols].itertuples(index=False, name=None)), key=str)
    for r in docs.collect():
        raw = (r.text or "").encode()
        image = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        own = got[got["payload_sha256"] == hashlib.sha256(image).hexdigest()].iloc[0]
        lines = b"".join(b"\0" + image[k : k + 64] for k in range(0, len(image), 64))
        stored_as = media.png_encode(raw)
        at, body = 8, b""
        while at < len(stored_as):  # a plain reader of the format's chunks
            size, kind = int.from_bytes(stored_as[at : at + 4]), stored_as[at + 4 : at + 8]
            data = stored_as[at + 8 : at + 8 + size]
            assert zlib.crc32(kind + data) == int.from_bytes(stored_as[at + 8 + size : at + 12 + size])
            body += data if kind == b"IDAT" else b""
            at += 12 + size
        assert zlib.decompress(body) == lines and own["media_sha256"] == hashlib.sha256(stored_as).hexdigest() and own["media_bytes"] == len(stored_as)
    assert got.groupby("payload_sha256")[["media_bytes", "media_sha256", "feature"]].nunique().max().max() == 1
    assert media.media_column(none).count() == 0


def test_archive_members_are_read_once_whatever_the_range(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/a"
    media.write_archives(docs, folder, archive_bytes=2000)
    one, many = (media.read_archives(spark, folder, rangebytes=n).select("archive", "member", "offset", F.sha1("payload")).collect() for n in (1 << 30, 700))
    assert len(one) == docs.count() and sorted(one) == sorted(many)
    (tmp_path / "a" / "archive-left-behind.tar").write_bytes(next((tmp_path / "a").glob("*.tar")).read_bytes())
    assert media.read_archives(spark, folder).count() == docs.count()


def test_damaged_member_is_an_error_of_its_own(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/a"
    media.write_archives(docs.coalesce(1), folder)
    (path,) = (tmp_path / "a").glob("*.tar")
    data = bytearray(path.read_bytes())
    data[10] ^= 255
    path.write_bytes(data)
    rows = media.read_archives(spark, folder).collect()
    assert [r.error is None for r in rows].count(False) == 1 and rows[0].attempts == 3 and rows[0].payload is None


PAGES = [(1, "http://a", "x" * 1500), (2, "http://b\r\nEvil: 1", "x" * 1500), (3, None, "é" * 700), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "n", "x" * 1500), (9, "u", "x" * 1500), (9, "u", "x" * 1500), (10, "u", "a\r\n\r\nb" * 400)]


def plain_warc(pages):
    keep = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= 1000:
            keep[h] = max(keep.get(h) or -1, i if i is not None else -1)
    out = []
    for i, u, h in pages:
        raw = (h or "").encode()
        to = keep[h] if len(raw) >= 1000 and (i is None or i < keep[h]) else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    return out


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, refers_to string")
    got = warc.warc_round_trip(pages).drop("url").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_warc(PAGES), key=str)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("sf,bounds", [("sf0.001", {"roll_bytes": 20_000, "part_rows": 40}), ("sf0.1", {"part_rows": 300}), ("sf0.1", {})])
def test_warc_files_are_the_same_each_time_and_roll(spark, tmp_path, sf, bounds):
    pages = table(spark, f"/root/testdata/{sf}", "pages")
    dealt = {"a": pages, "b": pages, "c": pages.repartition(2, F.rand(1)), "d": pages.repartition(16, F.rand(2))}
    found = {k: sorted(map(tuple, warc.write_warc(x, f"file://{tmp_path}/{k}", **bounds).collect())) for k, x in dealt.items()}
    assert found["a"] == found["b"] == found["c"] == found["d"] and (not bounds or len(found["a"]) > 4)
    for name, _, size, sha1 in found["d"]:
        data = (tmp_path / "d" / name).read_bytes()
        assert len(data) == size and hashlib.sha1(data).hexdigest() == sha1
    assert not list((tmp_path / "a").glob("_*"))
    order = [r.page_id for name, *_ in found["a"] for r in warc.read_warc(spark.createDataFrame([(name,)], "file string"), f"file://{tmp_path}/a").collect()]
    assert order == sorted(order) and len(order) == pages.count()


def test_warc_parts_follow_ids(spark):
    ids = [None] * 7 + [-(1 << 63), (1 << 63) - 1, 0, -1] + [5] * 9 + list(range(100, 140)) + [(1 << 40) + k for k in range(30)]
    pages = spark.createDataFrame([(i, str(k), "x" * k) for k, i in enumerate(ids)], "page_id long, url string, html string")
    placed, parts = warc.with_parts(pages, 4, F.xxhash64("url", "html"))
    rows = placed.select("page_id", "part", F.xxhash64("url", "html").alias("h")).collect()
    assert len(rows) == len(ids)
    order = sorted(rows, key=lambda r: (r.page_id is not None, r.page_id or 0, r.h))
    assert [r.part for r in order] == sorted(r.part for r in rows)
    sizes = pd.Series([r.part for r in rows]).value_counts()
    assert sizes.max() <= 8 and 15 < len(sizes) <= parts and max(sizes.index) < parts


def test_language_on_held_out_rows(spark, sf_dir):
    got = catalog.op5_language(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_of_awkward_rows(spark, docs, none):
    model = language.LanguageModel(["the of and", "der die und", "le la les", "el los una"] * 5, ["en", "de", "fr", "es"] * 5)
    got = {(r.doc_id, r.text): r.language for r in language.identify(docs, model).collect()}
    assert got[2, None].lang_pred == got[3, ""].lang_pred == got[4, " \n\t "].lang_pred == "und"
    assert got[0, TEXTS[0]].lang_pred == "en" and got[5, "x"].lang_pred != "und"
    assert {r.language.lang_pred for r in language.identify(docs, language.fit_language(none)).collect()} == {"und"}
    assert language.identify(none, model).count() == 0
    single = language.fit_language(docs.where("lang = 'fr'"))
    assert {r.language.lang_pred for r in language.identify(docs, single).collect()} == {"fr", "und"}


def test_language_means_match_a_plain_count(spark):
    weights = np.random.default_rng(0).normal(size=(2, language.BINS))
    texts = ["The of", "", "été à", "x"]
    got = language.gram_means(*language.padded(utf8(pa.array(texts))), weights)
    for t, row in zip(texts, got, strict=True):
        raw = b"  " + bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in "".join(c.lower() if c.isascii() else c for c in t).encode()) + b"  "
        bins = [language.gram_bins(np.frombuffer(raw[a : a + n], np.uint8), n)[0] for n in (2, 3) for a in range(len(raw) - n + 1)]
        want = weights[:, bins].sum(axis=1) / (2 * len(raw))
        # grams over a text's end hold only its last space and the next text's spaces
        assert np.allclose(row, want, atol=3 * np.abs(weights).max() / (2 * len(raw)))


def test_language_votes_match_a_plain_count():
    rng = np.random.default_rng(5)
    names = ["en", "de", "nl", "fr", "es", "pl"]
    letters = {x: rng.dirichlet(np.ones(26) * 0.3) for x in names}
    say = lambda x, n: "".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz"], n, p=letters[x]))
    model = language.LanguageModel([say(x, 60) for x in names for _ in range(8)], [x for x in names for _ in range(8)])
    texts = [say(x, 50) for x in names for _ in range(4)] + ["", "12 !", "q", None]
    got = list(zip(*model.predict(pa.array(texts)), strict=True))
    for t, (lang, score) in zip(texts, got, strict=True):
        if not re.search("[a-z]", t or ""):
            assert (lang, score) == ("und", 0)
            continue
        margins = language.gram_means(*language.padded(utf8(pa.array([t]))), model.weights)[0]

        def winner(level, rivals):
            votes, chance = dict.fromkeys(rivals, 0), dict.fromkeys(rivals, 0.0)
            for i, a in enumerate(rivals):
                for b in rivals[i + 1 :]:
                    p = 1 / (1 + np.exp(-2 * margins[model.machines[level, a, b]]))
                    votes[a if p >= 0.5 else b] += 1
                    chance[a] += p
                    chance[b] += 1 - p
            best = max(rivals, key=lambda x: (votes[x], chance[x]))
            return best, chance[best] / (len(rivals) - 1) if len(rivals) > 1 else 1.0

        first, p = winner("family", model.families)
        want, q = winner(first, model.members[first])
        assert lang == want and score == pytest.approx(p * q)
    assert np.mean([a == names[k // 4] for k, (a, _) in enumerate(got[:24])]) > 0.9


def test_every_language_is_learned(spark):
    codes = [f"{a}{b}" for a in "abcdefghijk" for b in "nopqrstuvwx"]
    rows = [(2 * i + k, f"{c} " * 20, c) for i, c in enumerate(codes) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small = docs.where("lang > 'j'")
    model = language.fit_language(small)
    assert model.langs == [c for c in codes if c > "j"]
    assert [r.language.lang_pred for r in language.identify(small, model).orderBy("doc_id").collect()] == [r[2] for r in rows if r[2] > "j"]


def test_toxicity_scores_match_plain_sums():
    rng = np.random.default_rng(2)
    vocabulary = ["one", "three", "somewhat", "several", "é"]
    hashes = np.unique(np.concatenate([h for _, h in toxicity.terms(pa.array([" ".join(vocabulary)]))]))
    machine = toxicity.FactorizationMachine(hashes, -0.3, rng.normal(size=len(hashes)), rng.normal(size=(len(hashes), 3)))
    texts = ["one three somewhat", "ONE one, one", "", "other words", "several é somewhat one", None]
    for t, got in zip(texts, machine.score(pa.array(texts)), strict=True):
        own = {int(h) for _, hs in toxicity.terms(pa.array([t], pa.string())) for h in hs}
        at = [i for i, h in enumerate(machine.hashes.tolist()) if h in own]
        z = machine.bias + sum(machine.weights[i] for i in at) + sum(machine.factors[i] @ machine.factors[j] for i in at for j in at if i < j)
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_learns_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"bad word {k}") for k in range(50)] + [(k, "good word") for k in range(2, 9)] + [(9, "bad bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 1)] + [(k, 0) for k in range(2, 9)], "doc_id long, toxic int")
    seen = []
    real = toxicity.train
    toxicity.train = lambda labels, *rest, **more: seen.append(labels) or real(labels, *rest, **more)
    try:
        toxicity.fit_toxicity(docs, labels)
    finally:
        toxicity.train = real
    assert sorted(seen[0].tolist()) == [0.0] * 7 + [1.0] * 2


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = catalog.op6_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_toxicity_without_labels_and_of_awkward_rows(spark, docs, none):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    machine = toxicity.fit_toxicity(docs, nothing)
    assert {r.toxicity < 0.5 for r in toxicity.score_toxicity(docs, machine).collect()} == {True}
    some = spark.createDataFrame([(0, 1), (1, 1), (2, None), (None, 1), (5, 0), (9, 0), (10, 0)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, some), into="score")
    assert scored.columns.count("score") == 1 and scored.count() == docs.count()
    assert toxicity.score_toxicity(none, machine).count() == 0


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (2000, 2))
    label = (rows[:, 0] & rows[:, 1]).astype(float)
    docs, slots = np.nonzero(rows)
    machine = toxicity.train(label, docs, np.array([11, 22], np.uint64)[slots])
    z = [machine.bias, *(machine.bias + machine.weights), machine.bias + machine.weights.sum() + machine.factors[0] @ machine.factors[1]]
    assert max(z[:3]) < 0 < z[3]


def plain_simhash(text, width=4):
    w = re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    w = [x for x in w if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(rows, budget=4):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(rows)]


def test_near_duplicates(spark, docs, none, sf_dir):
    for source in (docs, table(spark, sf_dir, "documents")):
        rows = [(r.doc_id, plain_simhash(r.text)) for r in source.collect()]
        assert sorted(map(tuple, simhash.near_duplicates(source).collect()), key=str) == sorted(plain_components(rows), key=str)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("group_rows", [20_000, 5])
def test_trie_join_of_crowded_words(spark, group_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([base[k % 6] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5), dtype=np.uint64)) for k in range(400)] if False else [[base[k % 6] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5), dtype=np.uint64))] for k in range(400)]).ravel())
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = connected_components(simhash.near_links(nodes, 4, group_rows)).collect()
    root = {r.node & (2**64 - 1): r.root for r in found}
    want = plain_components([(i, int(x)) for i, x in enumerate(fps)])
    groups = {}
    for (_, fp, c) in want:
        groups.setdefault(c, set()).add(root.get(int(fp, 16), fp))
    assert all(len(x) == 1 for x in groups.values()) and len({*map(str, (next(iter(x)) for x in groups.values()))}) == len(groups)


def plain_similar(rows, least=0.8, width=5):
    def shingles(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
        return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}

    sets = [shingles(t) for _, t in rows]
    by = {}
    for i, own in enumerate(sets):
        for x in own:
            by.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unequal = []
    for i, own in enumerate(sets):
        shared = {}
        for x in own:
            for j in by[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n >= least * (len(own) + len(sets[j]) - n):
                root[find(i)] = find(j)
                if sets[i] != sets[j]:
                    unequal.append((rows[i][0], rows[j][0]))
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    return [(d, first.get(find(i))) for i, (d, _) in enumerate(rows)], unequal


def kept_of(components):
    """The id that stays of each component, by plain rules."""
    best = {}
    for d, c in components:
        best[c] = min(best.get(c, (True, 0)), (d is None, d or 0))
    return {None if none else d for none, d in best.values()}


@pytest.mark.parametrize("bounds", [{}, {"group_rows": 3, "pile_bytes": 500, "broadcast_ids": 2}])
def test_similar_documents(spark, docs, none, sf_dir, bounds):
    sources = [docs, table(spark, sf_dir, "documents")] + ([] if bounds else [table(spark, "/root/testdata/sf0.01", "documents")])
    for source in sources:
        rows = [(r.doc_id, r.text) for r in source.collect()]
        want, unequal = plain_similar(rows)
        got = simhash.similar_documents(source, **bounds).collect()
        assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(want, key=str)
        kept = simhash.without_similar(source, **bounds).collect()
        assert len(kept) == len({r.component_id for r in got}) and {r.doc_id for r in kept} == kept_of(want)
        assert sorted(r.text or "" for r in kept) == sorted({r.text or "" for r in kept})
    assert bounds or len(unequal) > 8
    assert simhash.similar_documents(none, **bounds).count() == simhash.without_similar(none, **bounds).count() == 0


def test_near_duplicates_stage_goes_by_row(spark):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve", "thirteen fourteen fifteen")
    rows = [(3, a), (5, a), (5, b), (9, c), (9, c), (None, "only here"), (None, b), (1 << 60, None), (None, ""), ((1 << 60) + 1, " ")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, _key string, first string, c0 string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, a), (5, b), (9, c), (None, "only here"), (1 << 60, None)], key=str)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=40, unique=True), min_size=1, max_size=6))
def test_wide_fingerprints_are_majorities(sets):
    values = np.concatenate([np.sort(mix(np.array(x, np.uint64))) for x in sets])
    at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    odd = np.random.default_rng(42).integers(0, 1 << 63, 3, dtype=np.uint64)
    got = shingles.wide_fingerprints(values, at, 3)
    for k in range(len(sets)):
        for lane in range(3):
            h = [int(x) for x in mix(values[at[k] : at[k + 1]] ^ odd[lane])]
            assert int(got[k, lane]) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("n", [3, 400])
def test_trie_forest_of_wide_words(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, (12, 4), dtype=np.uint64)
    own = base[np.arange(n) % 12] ^ np.packbits(rng.random((n, 4, 64)) < 0.06, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    groups = np.sort(rng.integers(0, 3, n))
    order = np.lexsort((own[:, 0], groups))
    own = own[order]
    budgets = np.append(np.minimum(np.arange(65), 12), 30)
    root = simhash.trie_forest(np.ascontiguousarray(own[:, 0]), groups, budgets, own[:, 1:])
    far = np.bitwise_count(own[:, None] ^ own[None]).astype(int)
    linked = (far.sum(axis=2) <= 30) & (far[:, :, 0] <= 12) & (groups[:, None] == groups[None])
    want = np.arange(n)
    for _ in range(n):
        want = np.array([want[linked[i]].min() for i in range(n)])
    assert (root == want).all() and (n < 12 or len(set(want)) < n)


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(1).selectExpr("id + 1000", "id + 1001"))
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert len({got[i] for i in range(301)}) == 1 and got[1000] == got[1001] != got[0]


def plain_backoff(rows, order, least, alpha=0.4):
    from collections import Counter
    from math import log

    texts = [(d, ("<s>", *plain_words(t))) for d, t in rows]
    total = sum(len(x) - 1 for _, x in texts)
    seen = Counter(x[i : i + m] for _, x in texts for m in range(1, order + 1) for i in range(len(x) - m + 1))
    out = []
    for d, x in texts:
        score = 0.0
        for i in range(1, len(x)):
            most = min(order, i + 1)
            m = next(m for m in range(most, 0, -1) if m == 1 or seen[x[i - m + 1 : i + 1]] >= least)
            gram = x[i - m + 1 : i + 1]
            score += (most - m) * log(alpha) + log(seen[gram] / (seen[gram[:-1]] if m > 1 else total))
        out.append((d, len(x) - 1, round(score, 6), round(score / (len(x) - 1), 8) if len(x) > 1 else None))
    return out


@pytest.mark.parametrize("order,least,block_bytes", [(2, 1, 1 << 24), (2, 2, 30_000), (1, 1, 1), (3, 2, 1), (4, 1, 1 << 24)])
def test_backoff_scores(spark, docs, none, order, least, block_bytes):
    want = plain_backoff([(r.doc_id, r.text) for r in docs.collect()], order, least)
    found = lm.backoff_scores(docs, order=order, least=least, block_bytes=block_bytes)
    got = [(r.doc_id, r.n_words, round(r.log_score, 6), None if r.mean_log_score is None else round(r.mean_log_score, 8)) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert lm.backoff_scores(none, order=order).count() == 0


def test_backoff_scores_of_shuffled_rows(spark, sf_dir):
    source = table(spark, sf_dir, "documents")
    want = {r[0]: r[1:] for r in plain_backoff([(r.doc_id, r.text) for r in source.collect()], 2, 1)}
    for rows in (source, source.repartition(7, F.rand(3))):
        got = lm.backoff_scores(rows, block_bytes=50_000).collect()
        assert len(got) == len(want)
        for r in got:
            assert (r.n_words, r.log_score) == (want[r.doc_id][0], pytest.approx(want[r.doc_id][1], abs=1e-5))


CONTROL_TEXTS = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|> \\ <<SYS>>", "", None, "plain", "a" * 3000]


def conversations(spark):
    rows = [(c, t, ("system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]), CONTROL_TEXTS[(c + t) % len(CONTROL_TEXTS)] if c < 6 else f"turn {t} " * 30) for c in range(8) for t in range(4 if c < 6 else 60)]
    rows += [(0, 2, "assistant", "tie"), (None, 0, "user", "x"), (None, None, None, "y"), (20, 0, "sys%0A\ntem", "z"), (20, 0, "sys%0A\ntem", "z"), (21, 0, "system", "only")]
    return spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, window string")


def test_chat_reads_back(spark):
    turns = conversations(spark)
    windows = chat.format_conversations(turns)
    got = {r.conv_id: r for r in chat.conversation_digests(windows).collect()}
    by = {}
    for r in turns.collect():
        by.setdefault(r.conv_id, []).append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
    chars = {r[0]: r[1] for r in windows.groupBy("conv_id").agg(F.sum(F.length("formatted"))).collect()}
    assert got.keys() == by.keys()
    for c, own in by.items():
        own.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest()), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == chars[c]
    assert chat.conversation_digests(chat.format_conversations(turns.limit(0))).count() == 0


def test_chat_windows_keep_to_the_budget(spark):
    windows = chat.format_conversations(conversations(spark), budget=400, history=80).where("conv_id = 7").orderBy("window").collect()
    assert len(windows) > 3 and [w.window for w in windows] == list(range(len(windows)))
    for w in windows:
        assert w.tokens <= 400 and not w.over_budget
        assert w.formatted.startswith("<|im_start|>system\nturn 0 ")
        assert w.formatted.count("<|im_end|>\n") == len(w.fresh)
        if w.window:
            assert not w.fresh[0] and not w.fresh[1] and any(w.fresh)
    assert sum(sum(w.fresh) for w in windows) == 60


@settings(max_examples=100, deadline=None)
@given(st.text("<|>[]/\\imINSTs_endart", max_size=30))
def test_escape_pattern_is_reversible(text):
    out = re.sub(rf"([<\[])(\\*)({chat._RESTS})", r"\1\\\2\3", text)
    assert re.sub(rf"([<\[])\\(\\*)({chat._RESTS})", r"\1\2\3", out) == text
    assert not any(c in out for c in chat.CONTROLS)


PATH = public_tokenizers.path("word_bpe_49k.json")


def test_token_files(spark, docs, none, sf_dir, tmp_path):
    whole = Tokenizer.from_file(PATH)
    for source in (docs, table(spark, sf_dir, "documents")):
        got = sorted(map(tuple, tokens.token_files(source, PATH).collect()), key=lambda r: r[1])
        rows = [(r.doc_id, [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in source.collect()]
        want, at = {}, 0
        for d, ids in rows:
            want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        for d, start, n, crc in got:
            assert start == at
            at += n
            want[d].remove((n, crc))
        assert not any(want.values())
        ids = [-1 if d is None else d for d, *_ in got]
        assert ids == sorted(ids)
    assert tokens.token_files(none, PATH).count() == 0


def test_a_worker_keeps_its_tokenizer():
    own = tokens.word_tokenizer(PATH)
    first, at = own.encode(pa.array(["one two", None, "two three"]), 1)
    assert tokens.word_tokenizer(PATH) is own
    again, at_again = own.encode(pa.array(["one two", None, "two three"]), 1)
    assert first.tolist() == again.tolist() and at.tolist() == at_again.tolist()


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abAB'.,;:! \n\t\r \u0085́éÉİß12<|>endoftx中"), max_size=60))
def test_tokens_of_cut_texts(text):
    if not hasattr(test_tokens_of_cut_texts, "t"):
        test_tokens_of_cut_texts.t = tokens.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    own, whole = test_tokens_of_cut_texts.t
    for t in (text, "İ", "x<|endoftext|>", "<|ENDOFTEXT|>"):
        ids, _ = own.encode(pa.array([t]), 1)
        assert ids.tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aB1é×÷(-*.,)' \u00d6\u00f8"), max_size=20))
def test_tokens_of_signs_between_letters(text):
    if not hasattr(test_tokens_of_signs_between_letters, "t"):
        test_tokens_of_signs_between_letters.t = tokens.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    own, whole = test_tokens_of_signs_between_letters.t
    for t in (text, "(×2)", "-÷", "*×", ".×", "a×b÷c", "'×a", "×", "÷'é"):
        ids, _ = own.encode(pa.array([t]), 1)
        assert ids.tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1], t


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out[:n]


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_tokens_of_pieces_that_linear_hashes_confuse(n):
    own, whole = tokens.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    text = thue_morse(n) + " " + thue_morse(n).translate(str.maketrans("ab", "ba"))
    assert own.encode(pa.array([text, text]), 1)[0].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1] * 2


def test_tokens_with_equal_hashes(monkeypatch):
    own, whole = tokens.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    monkeypatch.setattr(tokens, "range_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) // np.uint64(9))
    texts = ["one three", "internationalism communications one", "three " * 5, "", "communications"]
    for _ in range(2):
        want = [i for t in texts for i in [*whole.encode(t, add_special_tokens=False).ids, 1]]
        assert own.encode(pa.array(texts), 1)[0].tolist() == want
        texts = texts[::-1]


def test_token_files_of_another_vocabulary(spark, tmp_path):
    words_ = [f"w{i}" for i in range(70_000)]
    path = str(tmp_path / "words.json")
    from tokenizers import models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({w: i for i, w in enumerate(["?", *words_])}, unk_token="?"))
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    plain.save(path)
    assert not tokens.WordTokenizer(path).cuts
    source = spark.createDataFrame([(i, " ".join(words_[i * 10_000 : (i + 1) * 10_000]) + " W1 w1") for i in range(7)], "doc_id long, text string")
    want = [(r.doc_id, [*plain.encode(r.text).ids, 1]) for r in source.collect()]
    got = sorted(map(tuple, tokens.token_files(source, path).collect()))
    assert [(d, n, crc) for d, _, n, crc in got] == [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=900), st.integers(0, 5))
def test_huffman_round_trip(ids, steep):
    ids = np.array(ids, np.int64)
    counts = np.bincount(ids, minlength=50) * (np.arange(50) + 1) ** (2 * steep)
    lengths = huffman.code_lengths(counts)
    if len(ids):
        assert (2.0 ** -lengths[counts > 0].astype(float)).sum() <= 1 and lengths.max() <= huffman.LIMIT
    bits, at = huffman.encode(ids, huffman.canonical_codes(lengths), lengths)
    assert huffman.Decoder(lengths).decode(bits, at, len(ids)).tolist() == ids.tolist()


def test_huffman_limit_and_best_lengths():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765, 10946])
    lengths = huffman.code_lengths(counts)
    assert lengths.max() == huffman.LIMIT and (2.0 ** -lengths.astype(float)).sum() == 1
    assert sorted(huffman.code_lengths(np.array([1, 1, 2, 4])).tolist()) == [1, 2, 3, 3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab é.", max_size=12), min_size=1, max_size=8))
def test_words_and_hashes(texts):
    text = utf8(pa.array(texts))
    found = words(text)
    got = [[text.data[a:b].tobytes().decode() for a, b in zip(found.starts[x:y], found.ends[x:y], strict=True)] for x, y in zip(found.first, found.first[1:], strict=False)]
    assert got == [plain_words(t) for t in texts]
    hashes = range_hashes(text.data, found.starts, found.ends)
    flat = [w for x in got for w in x]
    assert all((flat[i] == flat[j]) == (hashes[i] == hashes[j]) for i in range(len(flat)) for j in range(i))


def test_pipeline_stages_keep_clean_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.schema == docs.schema, name
        assert 0 < after.count() <= before
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_of_awkward_rows(spark, docs, tmp_path):
    sf = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", F.col("n_words").alias("n_chars")).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} <= {*range(11), None}


def test_sql_agrees(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in catalog.ORACLE_SQL.items():
        want = con.execute(sql).df()
        got = catalog.QUERIES[name](spark, sf_dir).toPandas()[list(want.columns)]
        key = list(want.columns)
        a, b = (x.astype(object).where(x.notna(), None).sort_values(key[0]).reset_index(drop=True) for x in (got, want))
        for c in key:
            if got[c].dtype == float:
                assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=1e-9, equal_nan=True), (name, c)
            else:
                assert json.loads(a[c].to_json()) == json.loads(b[c].to_json()), (name, c)
