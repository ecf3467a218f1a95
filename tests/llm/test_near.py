"""Near-duplicate operators against plain Python."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import lines, minhash, near, paragraphs
from tagloom.llm.common import Scratch

SCHEMA = "doc_id long, text string, digest int, id int, _rid int"


def make(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in texts], SCHEMA)


def groups(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(keys), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def corpus(seed=1, n=25):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    base = [[word() for _ in range(r.choice([2, 5, 40, 150]))] for _ in range(n)]
    texts = []
    for b in base:
        for _ in range(r.randint(1, 4)):
            c = list(b)
            for _ in range(r.randint(0, max(1, len(b) // 60))):
                c[r.randrange(len(c))] = word()
            texts.append(" ".join(c).title() if r.random() < 0.2 else " ".join(c))
    return texts + [None, "", " \n ", texts[0], texts[0], "é " * 3, "word " * 4000, "x" * 60_000]


def test_documents(spark):
    texts = list(enumerate(corpus(), 5))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(make(spark, [*texts, texts[3]])).collect()}
    sets = {i: shingles(t, 3) for i, t in texts}
    want = groups(sets, lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_the_pipeline_takes_five_words_and_four_fifths(spark):
    import corpus_pipeline

    base, more = [f"w{i}" for i in range(1000)], [f"v{i}" for i in range(400)]
    docs = [(1, base), (2, base + more[:215]), (3, base[180:]), (4, more[:150] + base[:750] + more[150:300])]  # 0.82 and 0.82 of base, and less
    got = corpus_pipeline.drop_copies(spark, make(spark, [(i, " ".join(w)) for i, w in docs]), None)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 4]
    thin = minhash.near_duplicates(make(spark, [(i, " ".join(w)) for i, w in docs])).filter("kept")
    assert thin.count() == 4


def test_no_documents_and_no_ids(spark):
    assert minhash.near_duplicates(make(spark, [])).count() == 0
    got = minhash.near_duplicates(make(spark, [(None, "a b c d"), (3, "a b c d"), (None, "else"), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, False), (0, 0, False), (0, 3, False), (3, 3, True)]


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    r = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        c = list(base)
        c[r.randrange(80)] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(c))
    c = list(base)
    for i in range(26):  # a chain that leads away from the others
        c[3 * i] = f"x{i}"
        texts.append(" ".join(c))
    docs = list(enumerate(texts))
    want = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make(spark, docs)).collect()}
    for name, value in (("MAX_ITEMS", 8), ("BIG_BUCKET", 10), ("BROADCAST_IDS", 0), ("PIVOTS", 2)):
        monkeypatch.setattr(near, name, value)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make(spark, docs)).collect()} == want
    sets = {i: shingles(t, 3) for i, t in docs}
    assert want == groups(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    got = {x["id"]: x["comp"] for x in near.components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {frozenset(e) for e in edges}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == groups(nodes, lambda a, b: frozenset((a, b)) in linked)


def test_few_links_are_followed_at_once(spark, monkeypatch):
    r = random.Random(9)
    edges = [(r.randrange(-80, 80), r.randrange(-80, 80)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)]
    links, scratch = spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")
    got = {x["id"]: x["comp"] for x in near.components(scratch, links).collect()}
    assert scratch.n == 1
    assert near.components(scratch, links.filter("false")).collect() == []
    monkeypatch.setattr(near, "DRIVER_LINKS", 0)
    assert got == {x["id"]: x["comp"] for x in near.components(scratch, links).collect()}


def test_few_links_are_written_in_few_files(spark, monkeypatch):
    from tagloom.llm.segments import remove

    r, files = random.Random(14), []
    words = [["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(12)] for _ in range(300)]
    docs = [(i, " ".join(w)) for i, w in enumerate(words)] + [(300 + i, " ".join([*w[:11], "other"])) for i, w in enumerate(words)]
    want = sorted((i, [] if i < 300 else [0]) for i, _ in docs)
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old, write = {k: spark.conf.get(k) for k in conf}, Scratch.write

    def noted(self, df, *args, **options):
        out = write(self, df, *args, **options)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(Scratch, "write", noted)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = remove(make(spark, docs), lines.METHOD).select("doc_id", "removed").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((x["doc_id"], x["removed"]) for x in got) == want
    assert sum(f > 24 for f in files) <= 3 and len(files) > 5  # the links, and what is read from documents


def test_half_blocks_of_a_large_group_meet_once(spark, tmp_path):
    def alone(groups):
        for items, _, sides in groups:
            if sides is not None:
                pairs = [f"{min(int(a), int(b))} {max(int(a), int(b))}\n" for (a, s), (b, t) in combinations(zip(items, sides, strict=True), 2) if s != t]
                (tmp_path / str(random.SystemRandom().random())).write_text("".join(pairs))
        return [np.arange(len(items)) for items, *_ in groups]

    rows = spark.createDataFrame([(1, i, str(i).encode()) for i in range(40)], "comp long, id long, item binary")
    assert near.settle(Scratch(spark, "t"), rows, alone, most_items=8).count() == 0
    met = [x for f in tmp_path.iterdir() for x in f.read_text().splitlines()]
    assert len(met) == len(set(met)) > 600


@pytest.mark.parametrize("method", [lines.METHOD, paragraphs.METHOD])
def test_segments(spark, method):
    r = random.Random(4)
    pool = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(12)]
    docs = [(i, "\n".join([r.choice(pool).upper() if r.random() < 0.1 else r.choice(pool) for _ in range(4)] + ["short one", "", f"only in document number {i} with its words {i * 7919} and then some {i}"])) for i in range(12)]
    docs += [(50, None), (51, ""), (52, docs[0][1]), (52, docs[0][1]), (53, pool[0] + "x"), (54, "w " * 3000)]
    from tagloom.llm.segments import remove

    got = remove(make(spark, docs), method).collect()
    assert len(got) == len(docs)
    seen, want = {}, {}
    for i, t in docs:
        out = []
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            w = method.normalise(line).split()
            key = b" ".join(w)
            if key == b" ".join(method.normalise(pool[0] + "x").split()):
                key = b" ".join(method.normalise(pool[0]).split())  # a near copy
            if len(w) >= method.min_words and seen.setdefault(key, (i, k)) != (i, k):
                out.append(k)
        want[i] = out
    if method is lines.METHOD:  # lines that differ in digits only
        for i in range(1, 12):
            want[i] = sorted({*want[i], 6})
        want[52] = sorted({*want[52], 6})
    for x in got:
        assert x["removed"] == want[x["doc_id"]], x["doc_id"]
        text = dict(docs)[x["doc_id"]]
        assert x["text"] == (None if text is None else "\n".join(y for k, y in enumerate(text.split("\n")) if k not in x["removed"]))
        assert x["digest"] == 1 and x["id"] == 2 and x["_rid"] == 3
    assert remove(make(spark, []), method).count() == 0


def _meet(pairs):
    """Which pairs of lines share a block and are near enough by their sketches."""
    n = len(pairs)
    out = np.zeros(n, bool)
    for own, keys, sk in lines.blocks(near.Items([a for a, _ in pairs] + [b for _, b in pairs])):
        place = np.full(2 * n, -1)
        place[own] = np.arange(len(own))
        both = np.flatnonzero((place[:n] >= 0) & (place[n:] >= 0))
        x, y = place[:n][both], place[n:][both]
        out[both] |= (keys[x] == keys[y]).any(1) & (near.sized_apart(sk[x], sk[y]) <= lines.MAX_APART)
    return out


@pytest.mark.parametrize(("words", "typos", "least"), [((5, 8), 1, 0.98), ((5, 8), 2, 0.85), ((9, 15), 2, 0.95), ((9, 15), 3, 0.9), ((16, 60), 3, 0.97), ((16, 60), 0.03, 0.95), ((16, 60), 0.06, 0.8)])
def test_recall_of_typo_copies(words, typos, least):
    r = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(4000)]
    pairs = []
    for _ in range(400):
        a = " ".join(r.choice(vocabulary) for _ in range(r.randint(*words)))
        places = [i for i, c in enumerate(a) if c != " "]
        b = list(a)
        for i in r.sample(places, typos if typos >= 1 else int(typos * len(places))):
            b[i] = r.choice(letters)
        if lines.similar(a.encode(), "".join(b).encode()):
            pairs.append((a.encode(), "".join(b).encode()))
    assert len(pairs) > 300 and _meet(pairs).mean() >= least


def test_lines_against_all_pairs(spark):
    """The whole operator on noisy lines, held against the edit similarity of all pairs."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    found = []
    for _ in range(120):
        base = [word() for _ in range(r.choice([5, 7, 12, 30, 70]))]
        for _ in range(r.randint(1, 3)):
            w = list(base)
            for _ in range(max(1, len(w) // 12)):
                w[r.randrange(len(w))] = word()
            found.append(" ".join(w))
    r.shuffle(found)
    norm = [lines.normalise(x) for x in found]
    want = groups(range(len(found)), lambda a, b: lines.similar(norm[a], norm[b]))
    docs = [(i, "\n".join(found[3 * i : 3 * i + 3])) for i in range(-(-len(found) // 3))]
    from tagloom.llm.segments import remove

    got = {x["doc_id"]: x["removed"] for x in remove(make(spark, docs), lines.METHOD).collect()}
    gone = {3 * i + k for i, ks in got.items() for k in ks}
    due = {i for i in want if want[i] != i}
    assert gone <= due and len(gone) >= 0.95 * len(due)


def test_signed_votes():
    """Each bit of a block is the sign of a weighted sum of votes."""
    items = near.Items([b"alpha bravo charlie delta echo", b"alpha bravo charlie delta golf", b"x"])
    got = lines.word_votes(items)
    drawn = near.mix(near.minima(items.words, items.first, 4 * lines.WORD_BLOCKS))
    bits = lambda x: (x[..., None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(int)
    for b in range(lines.WORD_BLOCKS):
        votes = (2 * bits(drawn[:, 4 * b : 4 * b + 4]) - 1) * np.array([2, 1, 1, 1])[None, :, None]
        assert (bits(got[:, b]) == (votes.sum(1) > 0)).all()
    h, first = (items := near.Items([b"ab cdefg hi", b"x", b"", b"other words of it"])).grams(5)
    one, at = items.only(np.array([0, 3])).grams(5)
    assert first.tolist() == [0, 5, 6, 6, 16] and at.tolist() == [0, 5, 15] and (one == np.append(h[:5], h[6:])).all()


def test_all_pairs_of_a_group_that_meet_are_compared():
    """Also those that are further apart than the links that made the group."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9)))
    others = [" ".join(word() for _ in range(12)).encode() for _ in range(4)]
    seen = 0
    for _ in range(300):
        a = " ".join(word() for _ in range(12))
        b = "".join(r.choice("abcdefghijklmnop") if c != " " and r.random() < 0.12 else c for c in a)
        pair = [a.encode(), b.encode()]
        found = lines.blocks(near.Items(pair))
        bits = [near.sized_apart(sk[0], sk[1]) for own, keys, sk in found if len(own) == 2 and (keys[0] == keys[1]).any()]
        if not bits or not lines.STRONG < min(bits) <= lines.MAX_APART or not lines.similar(*pair):
            continue
        seen += 1
        assert lines.labels([(others + pair, None), (pair, None)])[0].tolist() == [0, 1, 2, 3, 4, 4]
    assert seen > 3


def test_only_pairs_across_sides_and_labels_meet():
    g = [f"one line of several words that is repeated with {w} in it".encode() for w in "abc abd abe abf abg abh abi abj".split()]
    sides, known = np.array([1, 1, 1, 1, 2, 2, 2, 2]), np.array([0, 1, 2, 3, 0, 5, 6, 7])
    pairs = {(i, j) for _, _, i, j in lines._meeting([g], 20).tolist()}
    assert pairs and {(i, j) for _, _, i, j in lines._meeting([g], 20, [known], [sides]).tolist()} == {(i, j) for i, j in pairs if i < 4 <= j and (i, j) != (0, 4)}
    assert lines.labels([(g, known, sides)])[0].tolist() == [0] * 8


def test_letters_bound_the_distance():
    r = random.Random(12)
    texts = ["".join(r.choice("abcdeé中 ") for _ in range(r.randint(0, 30))) for _ in range(40)]
    i, j = np.array(list(combinations(range(40), 2))).T
    apart = lines._letters_apart(texts, i, j)
    assert all(d <= lines.edit_distance(texts[a].encode(), texts[b].encode(), 99) for a, b, d in zip(i, j, apart, strict=True))
    assert lines._letters_apart(["abc", "abdd"], np.array([0]), np.array([1])).tolist() == [2]


def test_members_of_a_hot_bucket_that_different_tasks_hold_meet(spark, monkeypatch):
    monkeypatch.setattr(near, "FLUSH", 300)
    far = 2**60 - 1  # 300 items of one key, the last one far from the leader; then one that is near the last one
    rows = [(i, far if i >= 299 else 0) for i in range(301)]

    def items_of(batch):
        for at in (slice(0, 300), slice(300, 301)):
            v = [tuple(map(int, x.as_py().split())) for x in batch.column(0)][at]
            sk = np.array([x for _, x in v], np.uint64)
            yield [(np.array([i for i, _ in v]), np.full((len(v), 1), 77, np.uint64), near.sized(sk, np.full(len(v), 50)))]

    docs = spark.createDataFrame([(f"{i} {x}",) for i, x in rows], "text string").coalesce(1)
    links = near.meet(Scratch(spark, "t"), docs, items_of, 301, 1, 13, 20).filter("g is null")
    assert {x["id"]: x["comp"] for x in near.components(Scratch(spark, "t"), links).collect()} == {i: 0 for i in range(301)}


def test_what_blocks_shuffled_goes_before_groups_are_compared(spark, monkeypatch):
    from tagloom.llm import segments

    done = []
    monkeypatch.setattr(Scratch, "free", lambda self: done.append("free"), raising=False)
    monkeypatch.setattr(segments, "linked_segments", lambda *given: done.append("compare"))
    segments.removals(Scratch(spark, "t"), make(spark, [(1, "a line of five words")]), lines.METHOD)
    assert done[:2] == ["free", "compare"]


def test_strong_links_get_fewer_as_lines_get_more(spark):
    """Else links by chance, which grow with the square of the lines, join most families of copies in one group."""
    from dataclasses import replace

    from tagloom.llm.segments import remove

    at = lines.METHOD.strong_at
    assert [at(n) for n in (0, 2_500_000, 5_000_000, 32_000_000, 160_000_000)] == [13, 13, 12, 9, 7]
    assert paragraphs.METHOD.strong_at(10**9) == paragraphs.METHOD.strong
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    found = []
    for _ in range(40):
        base = [word() for _ in range(r.choice([7, 12, 30]))]
        for _ in range(6):
            w = list(base)
            w[r.randrange(len(w))] = word()
            found.append(" ".join(w))
    r.shuffle(found)
    docs = make(spark, [(i, "\n".join(found[3 * i : 3 * i + 3])) for i in range(80)])
    some, none = ({x["doc_id"]: x["removed"] for x in remove(docs, replace(lines.METHOD, many=many)).collect()} for many in (None, 0.01))
    assert some == none and sum(map(len, some.values())) > 150


def test_whole_lines_are_fetched_for_pairs_of_like_letters_only(spark):
    from tagloom.llm.segments import _hopeful

    r = random.Random(2)
    texts = ["".join(r.choice("abcdeé中 ") for _ in range(r.choice([8, 9, 10, 300, 3000]))).encode() for _ in range(30)]
    texts += ["".join(r.choice(["", "x", *14 * [c]]) for c in x.decode()).encode() for x in texts]
    i, j = np.array(list(combinations(range(60), 2))).T
    rows = lines.letter_rows(texts)
    may = lines.may_be_similar(rows[i], rows[j])
    alike = lines.alike([(texts[a], texts[b]) for a, b in zip(i, j, strict=True)])
    assert alike.sum() > 10 and not (alike & ~may).any() and may.mean() < 0.5
    items = spark.createDataFrame([(1, b"one line of words"), (2, b"one line of word"), (3, b"zzzzzzzzzzzzzzzzz")], "id long, item binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert [tuple(x) for x in _hopeful(Scratch(spark, "t"), pairs, items, lines.METHOD).collect()] == [(1, 2)]


def test_long_lines_are_scanned_in_a_band(monkeypatch):
    r = random.Random(6)
    bands = []
    banded = lines._banded
    monkeypatch.setattr(lines, "_banded", lambda x, y, most: bands.append(most) or banded(x, y, most))
    a = "".join(r.choice("abcdé中 ") for _ in range(9000))
    b = "".join(r.choice(["", "x", "ab"]) if r.random() < 0.01 else c for c in a)
    d = lines.edit_distance(a.encode(), b.encode(), 1800)
    assert 0 < d <= bands[-1] < 500
    for _ in range(60):
        x = "".join(r.choice("abcdé中 ") for _ in range(r.choice([30, 200, 500])))
        share, most = r.choice([0.02, 0.1, 0.3]), r.choice([5, len(x) // 10, len(x) // 2])
        y = "".join(r.choice(["", "x", "ab"]) if r.random() < share else c for c in x)
        monkeypatch.setattr(lines, "BANDED", 1 << 40)
        want = lines.edit_distance(x.encode(), y.encode(), most)
        monkeypatch.setattr(lines, "BANDED", 16)
        got = lines.edit_distance(x.encode(), y.encode(), most)
        assert got == want if want <= most else got > most


def test_scans_of_many_pairs_agree_with_one():
    r = random.Random(4)
    pairs = []
    for _ in range(150):
        a = "".join(r.choice("abcdé-中") for _ in range(r.choice([3, 64, 65, 130, 300])))
        share = r.choice([0.05, 0.15, 0.25, 0.6])
        pairs.append((a.encode(), "".join(r.choice(["", "x", "ab"]) if r.random() < share else c for c in a).encode()))
    got = lines.alike(pairs)
    assert got.tolist() == [lines.similar(a, b) for a, b in pairs] and 30 < got.sum() < 120


def test_scans_stay_near_the_diagonal_and_take_unlike_lengths(monkeypatch):
    r, pairs, scans = random.Random(8), [], []
    for n in (30, 45, 63, 64, 65, 85) * 5 + (128, 200, 250, 330) * 2:
        y = x = "".join(r.choice("abcdefgh") for _ in range(n))
        for _ in range(r.randint(0, n // 2)):
            i = r.randrange(len(y))
            y = y[:i] + r.choice(["", "x", "yz"]) + y[i + r.randint(0, 1) :] or "a"
        y = r.choice([y, y, y[n // 5 :] + x[: n // 5], x[n // 8 :] + y[: n // 5]])
        x, y = sorted((x, y), key=len)
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row = row, [i]
            for j, d in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        pairs += [((x, y, most), row[-1] <= most) for most in (row[-1] - 1, row[-1], len(y) // 5) if most >= len(y) - len(x)]
    own, want = zip(*pairs, strict=True)
    assert lines._within(list(own)).tolist() == list(want) and 30 < sum(want) < len(want) - 30
    within = lines._within
    monkeypatch.setattr(lines, "_within", lambda x: scans.append(len(x)) or within(x))
    some = [tuple("".join(r.choice("abc") for _ in range(n)).encode() for _ in range(2)) for n in range(40, 120)]
    assert lines.alike(some).tolist() == [lines.similar(*p) for p in some]
    assert len(scans) == 1  # before lengths of three times the shortest: several of few pairs


def test_buckets_of_bounded_size_are_linked_at_once(monkeypatch):
    r = np.random.default_rng(5)
    size = [1, 2, 6, 7, 40, 300]
    key, ids = np.repeat(np.arange(len(size)), size).astype(np.uint32), r.permutation(sum(size)).astype(np.int64)
    few = r.integers(0, 2**63, 12, np.uint64)
    bits = (np.uint64(1) << r.integers(0, 60, (len(key), 3)).astype(np.uint64)) * (r.random((len(key), 3)) < 0.8).astype(np.uint64)
    sketch = near.sized(few[r.integers(0, 12, len(key))] ^ np.bitwise_xor.reduce(bits, axis=1), r.choice([90, 100], len(key)))
    monkeypatch.setattr(near, "_labels", None)
    sure, rest = near._bucket_clusters(key, ids, sketch, near.sized_apart, 4, 9)
    strong, far = set(), set()
    for k in range(len(size)):
        own = np.flatnonzero(key == k)
        near_ = {(a, b): int(near.sized_apart(sketch[a], sketch[b])) for a, b in combinations(own.tolist(), 2)}
        root = groups(own.tolist(), lambda a, b, n=near_: n[a, b] <= 4)
        strong |= {tuple(sorted((int(ids[root[a]]), int(ids[a])))) for a in root if root[a] != a} if size[k] > near.SMALL_BUCKET else {tuple(sorted((int(ids[a]), int(ids[b])))) for (a, b), n in near_.items() if n <= 4}
        far |= {tuple(sorted((int(ids[a]), int(ids[b])))) for (a, b), n in near_.items() if 4 < n <= 9 and (size[k] <= near.SMALL_BUCKET or root[a] != root[b])}
    assert {tuple(sorted(x)) for x in sure.tolist()} == strong and {tuple(x[1:]) for x in rest.tolist()} == far
    assert len(strong) > 100 and len(far) > 20


def test_hot_buckets_are_linked_by_stars(spark, monkeypatch):
    for name, value in (("FLUSH", 64), ("HOT", 4), ("BIG_PART", 6), ("PART_ENTRIES", 100)):
        monkeypatch.setattr(near, name, value)
    r = random.Random(7)
    base = [f"word{i}" for i in range(60)]
    texts = []
    for i in range(300):
        c = list(base)
        c[r.randrange(60)] = f"other{i}x"
        texts.append((i, " ".join(c)))
    from tagloom.llm.segments import remove

    got = {x["doc_id"]: x["removed"] for x in remove(make(spark, texts), lines.METHOD).collect()}
    assert got == {i: [0] if i else [] for i in range(300)}
    copies = [" ".join(f"new{i}{k}" if (k * 7 + i * 11) % 60 < 9 else w for k, w in enumerate(base)).encode() for i in range(20)]
    assert lines.central([*copies, " ".join(base).encode()])[0] == 20


@pytest.mark.parametrize("method", [lines.METHOD, paragraphs.METHOD])
def test_short_segments_and_scripts_without_blanks(spark, method):
    from tagloom.llm.segments import remove

    r = random.Random(6)
    han = "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(120))
    texts = [(1, f"Share this page\n12\n{han}\n---\n \n17"), (2, f"share this page\n34\n{han}\n---\n \n17"), (3, "本文です\n\nall new"), (4, "本文です\n\nall  new\n12")]
    got = {x["doc_id"]: x["removed"] for x in remove(make(spark, texts), method).collect()}
    assert got == {1: [], 2: [0, 2, 3, 5], 3: [], 4: [0, 2, 3]}
    if method is paragraphs.METHOD:  # 116 shingles each, of which 111 are shared
        assert [x["removed"] for x in remove(make(spark, [(1, han), (2, han[:60] + "新" + han[61:])]), method).orderBy("doc_id").collect()] == [[], [0]]


def test_word_hashes_do_not_depend_on_where_a_word_is(monkeypatch):
    text = ("some words, and é ß more of them; " * 50).encode()
    monkeypatch.setattr(near, "_SEGMENT", 64)
    small, starts = near.word_hashes(text)
    monkeypatch.undo()
    whole, at = near.word_hashes(text)
    assert (small == whole).all() and (starts == at).all() and len(set(whole[:8])) == 8 and whole[0] == whole[8]
    items = near.Items([b"a b c", b"", b"c", b" a  b\tc "])
    assert items.n_words.tolist() == [3, 0, 1, 3]
    s = items.sequence_hashes()
    assert (s[0] == s[3]).all() and not (s[0] == s[2]).any()
    assert [h.tolist() for h in near.Items([]).shingles(3)] == [[], [0]]


def test_minhash_and_odd_sketches_estimate_likeness():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**63, 1000, np.uint64)
    b = np.concatenate([a[:900], r.integers(0, 2**63, 100, np.uint64)])  # likeness 900 / 1100
    low = near.minima(np.concatenate([a, b]), np.array([0, 1000, 2000, 2000]), 2000)
    assert abs((low[0] == low[1]).mean() - 900 / 1100) < 0.04 and (low[2] == 2**64 - 1).all()
    sk = minhash.odd_sketches(low[:, :128])
    ones = int(near.popcount_apart(sk[0], sk[1]))
    assert ones <= minhash.MAX_ODD and int(near.popcount_apart(sk[0], minhash.odd_sketches(near.minima(r.integers(0, 2**63, 500, np.uint64), np.array([0, 500]), 128))[0])) > minhash.MAX_ODD
    assert near.banding(0.8, 4, 0.998) == paragraphs.BANDS


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(9)
    for _ in range(500):
        a, b = ("".join(r.choice("aé中") for _ in range(r.randint(0, 12))) for _ in range(2))
        most = r.randint(0, 12)
        d = lines.edit_distance(a.encode(), b.encode(), most)
        assert d == plain(a, b) if plain(a, b) <= most else d > most


def test_short_paragraphs_may_stay(spark):
    long = " ".join(f"w{i}" for i in range(25))
    docs = make(spark, [(1, f"{long}\nshort one here"), (2, f"short one here\n{long} and more"), (3, "short one here")])
    got = {r["doc_id"]: r["text"] for r in paragraphs.dedup_paragraphs(docs, 20).collect()}
    assert got == {1: f"{long}\nshort one here", 2: "short one here", 3: "short one here"}
    assert {r["doc_id"]: r["text"] for r in paragraphs.dedup_paragraphs(docs).collect()} == {1: f"{long}\nshort one here", 2: "", 3: ""}


def test_short_memory_of_driver(spark, tmp_path, monkeypatch):
    """What a table is written for leaves no free memory with the driver, nor does training."""
    from tagloom.llm import common, langid

    trimmed = []
    real = common.trim_driver
    monkeypatch.setattr(common, "trim_driver", lambda s: trimmed.append(s) or real(s))
    monkeypatch.setattr(langid, "trim_driver", common.trim_driver)
    monkeypatch.setattr(common.Scratch, "cleaned", 0.0)
    scratch = common.Scratch(spark, "trim")
    assert scratch.write(spark.range(5)).count() == 5 and len(trimmed) == 1
    scratch.write(spark.range(5))
    assert len(trimmed) == 1  # not for each table
    langid.fit(spark.createDataFrame([(1, "one two", "en")], "doc_id long, text string, lang string"))
    assert len(trimmed) == 2
    monkeypatch.setattr(common, "TRIM", "noSuchCommand")
    real(spark)  # a JVM without it


def test_sketches_cost_no_second_copy_of_words(monkeypatch):
    """Votes are drawn from the words and stretches where they are, and as they were drawn from copies of them."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 3000, int(k))).encode() for k in rng.integers(1, 90, 60)] + [b"ab abc", b"", b"x" * 300]
    items = near.Items(texts)
    for size, low, high, share in lines.GRAMS:
        length = np.diff(np.append(0, np.cumsum(items.sizes))[items.first])
        own = np.flatnonzero((length >= low) & (length < high))
        got = items.grams(size, share, own)
        plain = []
        for i in own.tolist():
            stream = texts[i].replace(b" ", b"")
            h = [np.uint64(int.from_bytes(stream[p : p + size], "little")) for p in range(max(1, len(stream) - size + 1))] if stream else []
            h = np.array(h, np.uint64)
            plain.append(near.mix(h[(h * near._MULT) >> np.uint64(64 - share) == 0] + near._MULT) if share else near.mix(h + near._MULT))
        assert [x.tolist() for x in plain] == [got[0][s:e].tolist() for s, e in zip(got[1][:-1], got[1][1:], strict=True)]
    before = lines.blocks(items)
    monkeypatch.setattr(near.Items, "only", None)  # a selection of items is a copy of their words
    for a, b in zip(before, lines.blocks(near.Items(texts)), strict=True):
        assert all((x == y).all() for x, y in zip(a, b, strict=True))


def test_groups_are_compared_together():
    """Groups of a stream come in one table until they are large enough."""
    batches = [pa.RecordBatch.from_pydict({"key": [k, k], "id": [2 * k, 2 * k + 1]}) for k in range(6)]
    sizes = lambda least: [t.num_rows for t in near.by_group(iter(batches), ["key", "id"], lambda t: [t], least)]
    assert sizes(1 << 20) == [12] and sum(sizes(0)) == 12 and len(sizes(0)) == 6
