"""Repeated passages against plain Python."""

import random

import numpy as np

from tagloom.llm import near, paragraphs, passages


def test_equal_stretches_select_an_equal_window():
    r = random.Random(5)
    shared = [f"s{r.randrange(10**6)}" for _ in range(50)]
    for a, b in ((0, 0), (3, 90), (40, 7), (200, 1)):
        one = [f"a{r.randrange(10**6)}" for _ in range(a)] + shared + [f"b{r.randrange(10**6)}" for _ in range(b)]
        two = [f"c{r.randrange(10**6)}" for _ in range(b)] + shared + [f"d{r.randrange(10**6)}" for _ in range(a)]
        items = near.Items([" ".join(one).encode(), b"", b"few words", " ".join(two).encode()])
        item, at, h = passages.selected(items.words, items.first)
        assert set(item) <= {0, 3} and (at[item == 0] <= len(one) - passages.WINDOW).all()
        first, second = ({tuple(x) for x in h[item == k].tolist()} for k in (0, 3))
        assert first & second
        alone = near.Items([" ".join(two).encode()])
        assert {tuple(x) for x in passages.selected(alone.words, alone.first)[2].tolist()} == second
    item, at, _ = passages.selected(near.Items([b"word " * 1000]).words, np.array([0, 1000]))
    assert len(at) < 50 and np.diff(at).max() <= passages.WINDOW


def test_passages_are_cut_to_the_word(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    planted = {"long": some(120), "just": some(51), "short": some(49)}
    docs, want = [], {}

    def add(i, *parts):
        text, out = "", ""
        for p, repeat in parts:
            own = "\n".join(" ".join(p[k : k + 40]) for k in range(0, len(p), 40)) if len(p) > 60 else " ".join(p)
            text += ("" if not text else " ") + own
            out += "" if repeat else ("" if not out else " ") + own
        docs.append((i, text))
        want[i] = out.split()

    add(1, (some(70), 0), (planted["long"], 0), (some(30), 0))
    add(2, (some(15), 0), ([w.upper() for w in planted["long"]], 1), (some(200), 0))
    add(3, (planted["just"], 0), (some(90), 0), (planted["short"], 0))
    add(4, (some(40), 0), (planted["just"], 1), (some(33), 0), (planted["short"], 0), (some(80), 0))
    add(5, (planted["long"], 1),)
    twice = some(60)
    add(6, (twice, 0), (some(25), 0), (twice, 1), (some(25), 0))
    add(7, (some(300), 0))
    docs += [(8, None), (9, ""), (10, "tiny text"), (7, docs[6][1])]
    d = spark.createDataFrame([(i, t, i, i, "x") for i, t in docs], "doc_id long, text string, _rid long, _made long, removed string")
    got = paragraphs.dedup_paragraphs(d).collect()
    assert len(got) == len(docs)
    for x in got:
        text = dict(docs)[x["doc_id"]]
        if text is None:
            assert x["text"] is None and x["removed"] == []
            continue
        assert (x["text"].split()) == want.get(x["doc_id"], text.split()), x["doc_id"]
        assert x["_rid"] == x["doc_id"] == x["_made"]
        kept, at = [], 0
        for s in x["removed"]:
            kept.append(text[at : s["start"]])
            at = s["end"]
        assert " ".join([*kept, text[at:]]).split() == x["text"].split()
    assert paragraphs.dedup_paragraphs(d.limit(0)).count() == 0


def test_a_passage_of_which_an_earlier_document_has_a_part(spark):
    r = random.Random(17)
    some = lambda n: [f"x{r.randrange(10**9)}" for _ in range(n)]
    docs, want = [], {}
    for k in range(0, 120, 3):  # a has less of what b and c share; in every second case d shares more with c
        whole, more = some(60 + k % 7 * 20), some(40)
        at = k % 12
        for i, words, left in ((k, whole[at : at + 40], None), (k + 1, whole, None), (k + 2, whole + more, more)):
            before, after = some(20), some(20)
            docs.append((i, " ".join(before + words + after)))
            want[i] = before + (words if left is None else left) + after
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x["doc_id"]: x["text"].split() for x in paragraphs.dedup_paragraphs(d).collect()}
    assert [i for i in want if got[i] != want[i]] == []
    seen = set()
    for words in got.values():
        own = {tuple(words[k : k + 50]) for k in range(len(words) - 49)}
        assert not own & seen
        seen |= own
