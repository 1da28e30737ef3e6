"""Cases that earlier versions got wrong: backing off, equal turns, copies that differ in white space."""

from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus import plain_words
from wavecrest.llm import catalog, chat, language, lm, packing, warc
from wavecrest.llm.common import table


def plain_scores_of_others(rows, order, least, alpha=0.4):
    texts = [("<s>", *plain_words(t)) for _, t in rows]
    grams = [Counter(x[i : i + m] for m in range(1, order + 1) for i in range(len(x) - m + 1)) for x in texts]
    total = sum(grams, Counter())
    n = sum(len(x) - 1 for x in texts)
    out = []
    for (d, _), x, own in zip(rows, texts, grams, strict=True):
        score, backed = 0.0, 0
        for i in range(1, len(x)):
            most = min(order, i + 1)

            def left(gram, own=own):
                return total[gram] - own[gram]

            m = next(m for m in range(most, 0, -1) if m == 1 or left(x[i - m + 1 : i + 1]) >= least)
            gram = x[i - m + 1 : i + 1]
            below = left(gram[:-1]) if m > 1 else max(n - len(x) + 1, 1)
            score += (most - m) * log(alpha) + log(max(left(gram), 1) / below)
            backed += m < most
        out.append((d, len(x) - 1, backed, round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("order", "least", "block_bytes"), [(2, 1, 1 << 24), (2, 2, 1), (3, 1, 60), (1, 1, 1 << 24)])
def test_scores_by_the_other_texts(spark, order, least, block_bytes):
    rows = [(1, "a b a b c"), (2, "a b c d"), (3, "only here only here"), (4, None), (5, ""), (6, "a b a b c"), (None, "b c d e"), (8, "A")]
    found = lm.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string"), order=order, least=least, block_bytes=block_bytes, leave_out=True)
    got = [(r.doc_id, r.n_words, r.n_backed_off, round(r.log_score, 6)) for r in found.collect()]
    assert sorted(got, key=str) == plain_scores_of_others(rows, order, least)


def test_one_text_has_no_others(spark):
    r = lm.backoff_scores(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), leave_out=True).first()
    assert (r.n_words, r.n_backed_off, round(r.log_score, 9)) == (2, 2, round(2 * log(0.4), 9))


def test_some_words_of_the_query_back_off(spark, sf_dir):
    share = catalog.op8_lm(spark, sf_dir).agg(F.sum("n_backed_off") / F.sum("n_words")).first()[0]
    assert 0.01 < share < 0.9


def test_equal_turns_keep_to_the_budget(spark):
    text = "x" * 200
    for rows in ([(1, 0, "user", text)] * 60, [(1, t, "user", text) for t in range(60)]):
        got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=1024)
        assert got.count() > 3 and not got.where("tokens > 1024 or over_budget").count()
        assert got.select(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] == 60


def test_copies_that_differ_in_white_space_are_one_cluster(spark):
    rows = [("hello world",), ("hello world\n",), ("\thello\n world ",), ("HELLO world",), (None,), ("hello worlds",), ("",), (" \n",)]
    got = [r.c for r in spark.createDataFrame(rows, "text string").select(packing.text_cluster().alias("c")).collect()]
    assert len(set(got[:4])) == 1 and got[4] is None and got[5] not in got[:4] and got[6] == got[7]


def test_warc_ranges_on_the_driver_are_bounded(spark):
    few, many = (warc.plan_parts(spark.range(n).select(F.col("id").alias("page_id")), 10, F.lit(1)) for n in (200_000, 2_000_000))
    assert few.seen <= 2 * warc.FIRST_RANGES and many.seen <= 2 * warc.FIRST_RANGES
    assert few.n <= 1.5 * warc.MOST_PARTS and many.n <= 1.5 * warc.MOST_PARTS and many.size >= 2_000_000 // warc.MOST_PARTS
    far = spark.range(100_000).select(F.when(F.col("id") % 1000 == 0, F.shiftleft("id", 40)).otherwise(F.col("id")).alias("page_id"))
    skewed = warc.plan_parts(far, 50, F.lit(1))
    assert skewed.seen <= 3 * warc.FIRST_RANGES and warc.in_parts(far, skewed, F.xxhash64("page_id")).groupBy("part").count().agg(F.max("count")).first()[0] <= 100


def test_warc_files_end_by_compressed_size(spark, tmp_path):
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    found = warc.write_warc(pages, f"file://{tmp_path}/w", part_bytes=4 << 20).toPandas().sort_values("file")
    assert found["records"].sum() == pages.count()
    part = found["file"].str[6:12]
    whole = found[part == part.shift(-1)]
    assert len(whole) > len(found) / 3 and (whole["bytes"] >= 1 << 20).all() and (whole["bytes"] < (1 << 20) + 200_000).all()


def test_a_language_of_long_texts_only_is_learned(spark):
    words = {"en": "the of and to in", "de": "der die und das nicht", "fr": "le la les des une"}
    rows = [(i * 3 + k, words[x] * (30 if x == "fr" else 3), x) for i in range(12) for k, x in enumerate(words)]
    docs = spark.createDataFrame([*rows, (100, None, "es"), (101, "", "es")], "doc_id long, text string, lang string")
    model = language.fit_language(docs, per_language=10, sample_bytes=4 * 10 * 200)
    assert model.langs == ["de", "en", "fr"]
    got = {r.lang: r.p for r in language.identify(docs, model).selectExpr("lang", "language.lang_pred as p").where("lang != 'es'").distinct().collect()}
    assert got == {x: x for x in words}
    assert language.fit_language(docs, per_language=10, sample_bytes=4 * 10 * 20).langs == ["de", "en"]
