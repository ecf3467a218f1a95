"""Quality rules, chats, mixture and SpotSigs against their SQL on awkward tables."""

import duckdb
import pandas as pd
import pytest

from tagloom.llm import chat, mixing, quality, spotsigs

DOCS = "doc_id long, text string, lang string, source string, extra int, tokens string"
LONG = "the cat sat on the mat and the dog ate a bone " * 30
ROWS = [
    (1, None, None, None, 1, "x"), (2, "", "en", "src1", 1, "x"), (3, " \t\n\x0b ", "en", "src0", 1, "x"), (4, "One word", "en", "src0", 1, "x"),
    (5, LONG, "en", "src0", 2, None), (5, LONG, "en", "src0", 2, None), (6, LONG + "\n" + LONG, "en", "src0", 2, None), (7, "a b c a b c a b c d", "fr", "other", 2, None),
    (8, "same line here\nsame line here\n\n\nnot this", "de", "src2", 2, None), (9, "##$$ %% <b> | & * " * 20, "en", "src2", 2, None), (10, "é ü \U0001d4d0 ß " * 40, "de", "src5", 2, None),
    (None, "no id at all, but the words of it", "en", "src1", 0, None), (11, "\n".join(f"- bullet line {i} of the list..." for i in range(30)), "en", None, 0, None), (12, "x" * 5000, "en", "src0", 0, None),
]


def compare(spark, name, schema, rows, result, sql):
    got = result(spark.createDataFrame(rows, schema)).toPandas()
    con = duckdb.connect()
    types = {"long": "BIGINT", "string": "VARCHAR", "int": "INTEGER"}
    fields = [f.strip().split() for f in schema.split(",")]
    con.execute(f"CREATE TABLE {name} ({', '.join(f'{n} {types[t]}' for n, t in fields)})")
    if rows:
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(fields))})", rows)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    show = lambda v: "-" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    want = sorted(tuple(show(v) for v in r) for r in cursor.fetchall())
    assert sorted(tuple(show(v) for v in r) for r in got[names].itertuples(index=False)) == want
    return got


@pytest.mark.parametrize("rows", [ROWS, []])
def test_quality(spark, rows):
    got = compare(spark, "documents", DOCS, rows, quality.judge, quality.oracle())
    if rows:
        by = got.set_index("doc_id")
        assert by.n_repeat_words[7] == 9 and by.n_dup_lines[8] == 1 and by.base_failed[1] and not by.kept[9]


def test_quality_with_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 9, 9, 9)], "doc_id long, text string, n_words int, kept int, _w int")
    assert quality.judge(d).first()["n_words"] == 2


@pytest.mark.parametrize("rows", [ROWS, []])
def test_spotsigs(spark, rows):
    if rows:
        got = compare(spark, "documents", DOCS, rows, spotsigs.fingerprints, spotsigs.oracle())
        same = got[got.doc_id == 5]
        assert same.fingerprint.nunique() == 1 and set(same.near_next) >= {1.0}
        assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    else:
        assert spotsigs.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_one_document_is_its_own_next(spark):
    r = spotsigs.fingerprints(spark.createDataFrame([(1, "the cat sat on the mat")], "doc_id long, text string")).first()
    assert r["near_next"] == 1.0


CHATS = "conv_id long, turn long, role string, text string, pos int, h1 string"
SAID = [
    (1, 0, "user", "hi", 0, ""), (2, 0, "user", "hi", 0, ""), (2, 1, "bot", "yes", 0, ""), (3, 0, "user", "hi", 0, ""), (3, 1, "bot", "yes", 0, ""), (3, 2, "user", "bye", 0, ""),
    (4, 0, "user", "hi", 0, ""), (4, 1, "bot", "no", 0, ""), (5, 5, "user", "hi", 0, ""), (5, 6, "bot", "no", 0, ""), (6, 0, None, None, 0, ""), (7, 0, None, "", 0, ""), (8, 0, "", None, 0, ""),
    (9, 0, "user", "hi", 0, ""), (9, 0, "user", "hi", 0, ""), (None, 0, "user", "lost", 0, ""), (10, None, "user", "hi", 0, ""), (10, 0, "bot", "yes", 0, ""), (10, 0, "bot", "zzz", 0, ""), (11, 0, "us", "erhi", 0, ""),
]


@pytest.mark.parametrize("rows", [SAID, []])
def test_chats(spark, rows):
    got = compare(spark, "conversations", CHATS, rows, chat.format_chats, chat.oracle())
    if rows:
        assert sorted(got.conv_id) == [3, 4, 6, 7, 8, 10, 11]  # 1 and 2 prefix 3; 5 equals 4; 9 is 1
        assert got.set_index("conv_id").n_equal[4] == 2


def mixed(docs):
    return mixing.mix(mixing.with_tokens(docs.select("doc_id", "text", "lang", "source")).select("doc_id", *mixing.LEVELS, "tokens")).select("doc_id", *mixing.LEVELS, "tokens", "epoch", "take_tokens")


@pytest.mark.parametrize("rows", [ROWS, []])
def test_mixture(spark, rows):
    compare(spark, "documents", DOCS, rows, mixed, mixing.oracle())


def test_mixture_shares_shortages_among_siblings(spark):
    rows = [(i, mixing_lang, source, 10) for i, (mixing_lang, source) in enumerate([("en", "src0")] * 100 + [("de", "src0")] * 2 + [("en", "src1")] * 100)]
    d = spark.createDataFrame([(i, "web" if s == "src0" else "books", lang, s, t) for i, lang, s, t in rows], "doc_id long, domain string, lang string, source string, tokens long")
    out = mixing.mix(d, weights={}, budget=1000, max_epochs=1, bucket_docs=7).toPandas()
    took = out.groupby(["domain", "lang"]).take_tokens.sum().to_dict()
    assert took == {("web", "en"): 480, ("web", "de"): 20, ("books", "en"): 500}  # web keeps its half
    assert out.doc_id.is_unique
    again = mixing.mix(d, weights={}, budget=1000, max_epochs=1, bucket_docs=50).toPandas()
    assert set(again.doc_id) == set(out.doc_id)
    assert mixing.mix(d, budget=0).count() == 0
    everything = mixing.mix(d, budget=10**9, max_epochs=3).toPandas()
    assert len(everything) == 3 * len(rows) and everything.take_tokens.sum() == 30 * len(rows)


def test_rows_of_a_mixture(spark):
    docs = spark.createDataFrame([(i, "some words of it " * (i % 5), "en", f"src{i % 4}", i) for i in range(60)], "doc_id long, text string, lang string, source string, _end int")
    out = mixing.select_rows(docs, budget_percent=50)
    assert out.columns == docs.columns and 0 < out.count() < 48 and out.filter("text = ''").count() == 0
