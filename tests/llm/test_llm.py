"""The training-data operators against brute force, on given rows and on awkward ones."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlake.llm import html_text, jaccard, mixing, packing, quality_model, quality_rules, substrings, topk, url_filter, wordpiece
from pairlake.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rnd = random.Random(5)
BASE = " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rnd.randrange(40)) for _ in range(220))
LONG = " ".join(f"w{rnd.randrange(3000)}" for _ in range(30_000))
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("alpha1", "changed"), "en", "b"), (4, None, "en", "a"), (5, "", None, None), (6, " \t\n ", "de", "a"),
    (7, "one two", "en", "a"), (8, "one two", "en", "a"), (9, "One  TWO", "en", "a"), (10, LONG, "fr", "c"), (11, LONG[5000:] + " tail", "fr", "c"), (12, "é" * 300, "fr", "c"),
    (13, "the same line\nthe same line\nthe same line again and again and again and again", "en", "a"), (13, "the same line\nthe same line\nthe same line again and again and again and again", "en", "a"),
    (None, BASE, "en", "a"), (None, None, None, None), (14, "x " + BASE[:400], "en", "a"), (15, "<|endoftext|> done  twice   thrice \n end ", "en", "a"),
]
CLASHING = ("score", "sig", "n", "token", "h", "s", "p", "w", "key", "of", "comp", "spans", "n_chars", "epoch", "k")


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents, with columns that operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def shingle_set(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both) and sets[j]:
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_jaccard(odd, docs):
    for df, k, percent in ((odd, 4, 85), (odd, 5, 80), (docs, 4, 85)):
        got = collections.Counter(map(tuple, jaccard.jaccard_components(df, k, percent).collect()))
        assert got == brute_components(texts(df), k, percent)
    kept = jaccard.keep_one(odd, 4, 85)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 10, 12, 13, 14, 15]
    assert jaccard.keep_one(odd.limit(0)).count() == 0
    assert jaccard.jaccard_components(odd.limit(0)).count() == 0


def test_near_copy_group_needs_few_pairs(spark):
    """Many near copies of one text: one component, also where copies differ from each other by more than the limit."""
    words = BASE.split()
    rows = []
    for i in range(60):
        w = list(words)
        for j in rnd.sample(range(len(w)), 3):
            w[j] = f"new{i}x{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(map(tuple, jaccard.jaccard_components(df, 4, 85).collect())) == brute_components(rows, 4, 85)


def test_suffix_filter_is_a_bound(spark):
    """What two sets share after the places of their first common shingle, in an order that puts some shingles first."""
    r = np.random.default_rng(1)
    rows, want = [], []
    for _ in range(20):
        a, b = (np.unique(r.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)) for _ in range(2))
        b = np.unique(np.concatenate([b[:30], a[:20]]))
        shared, key = np.intersect1d(a, b), lambda s: s ^ np.uint64(0x5555555555555555)
        first = shared[np.argsort(key(shared))[0]]
        found = []
        for s in (a, b):
            order = np.argsort(key(s))
            own = ~np.isin(s, shared)
            at = [i for i in order if not own[i]]
            k = [i for i, x in enumerate(at) if s[x] == first][0]
            found.append(jaccard.suffixes(s, own, np.array(at))[k].tolist())
        rows.append(found)
        want.append(len(shared) - 1)
    df = spark.createDataFrame(rows, "x array<int>, y array<int>").coalesce(1)
    got = [q.n for q in df.select(jaccard.after(F.col("x"), F.col("y")).alias("n")).collect()]
    assert all(g >= w for g, w in zip(got, want)) and sum(got) < sum(want) + 20 * 15


def test_all_links(spark):
    """Every link between rows, also those within a component that the components don't need."""
    words = BASE.split()
    rows = [(0, BASE), (0, BASE), (None, BASE), (1, None)]
    for i in range(2, 30):
        w = list(words)
        for j in rnd.sample(range(len(w)), i % 6):
            w[j] = f"odd{i}x{j}"
        rows.append((i, " ".join(w)))
    sets = [shingle_set(t, 4) for _, t in rows]
    want = collections.Counter()
    for i, a in enumerate(sets):
        n = sum(100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(sets) if i != j) if a else 0
        want[rows[i][0], len(a), n] += 1
    got, edges = jaccard.all_links(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert collections.Counter((r.doc_id, r.n_shingles, r.n_links) for r in got.collect()) == want
    assert edges.count() == len({frozenset((a, b)) for a in sets for b in sets if a != b and a and b and 100 * len(a & b) >= 85 * len(a | b)})


def test_one_id_with_several_texts(spark):
    """Of a component one row stays, whichever way its doc_id is repeated; empty texts all stay."""
    other = BASE.replace("alpha1", "changed")
    rows = [(1, BASE, "x"), (1, BASE, "y"), (1, other, "z"), (2, BASE, "x"), (3, "", "x"), (3, "", "x"), (None, BASE, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    kept = [tuple(r) for r in jaccard.keep_one(df, 4, 85).collect()]
    assert sorted(k[0] or 0 for k in kept) == [0, 1, 3, 3]
    assert {k[1] for k in kept if k[0] == 1} == {min(BASE, other, key=lambda t: hashlib.sha256(t.encode()).digest())}
    assert sorted(map(repr, kept)) == sorted(map(repr, (tuple(r) for r in jaccard.keep_one(df.repartition(5), 4, 85).collect())))


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def brute_removed(rows, length):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            if d is not None:
                s = b[i : i + length]
                first[s] = min(d, first.get(s, d))
    out = collections.Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        out[d, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    return out


def test_substrings(odd, docs):
    for df, length in ((odd, 50), (docs, 50), (odd, 100)):
        got = collections.Counter(tuple(r)[:5] for r in substrings.removed(df, length).collect())
        assert got == brute_removed(texts(df), length)
    assert substrings.removed(odd.limit(0)).count() == 0
    left = substrings.without_repeats(odd, 50)
    assert left.columns == odd.columns
    by = {r.doc_id: r for r in left.collect()}
    assert by[1].text == BASE and 2 not in by and by[7].text == "one two" and by[12].text == "é" * 300
    with pytest.raises(ValueError):
        substrings.removed(odd, 51)


def test_merged_transforms_give_the_repeated_intervals():
    alphabet = b"ab"
    contents = [bytes(rnd.choice(alphabet) for _ in range(rnd.randrange(40, 90))) for _ in range(12)]
    contents += [contents[0][5:60], contents[1][:45]]
    docs_, shard = np.arange(100, 100 + len(contents)), np.array([i % 3 for i in range(len(contents))])
    got = substrings.earlier(contents, docs_, shard, 36)
    first = {}
    for d, c in zip(docs_, contents):
        for i in range(len(c) - 35):
            first.setdefault(c[i : i + 36], d)
    for d, c, runs in zip(docs_, contents, got):
        assert {i for a, n in runs for i in range(a, a + n)} == {i for i in range(len(c) - 35) if first[c[i : i + 36]] < d}


def test_common_prefixes_of_merged_transforms():
    """The lengths that bounds appear at are the common prefixes of neighbouring rotations, in whole symbols."""
    contents = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(20, 40))) for _ in range(9)]
    parts = [substrings.Shard(contents[k::3], 20) for k in range(3)]
    who, common = substrings.merged(parts, 20)
    rotations = [[(c * 3)[i : i + 20] for c in contents[k::3] for i in range(len(c))] for k in range(3)]
    at = [0, 0, 0]
    row = []
    for k in who:
        row.append(rotations[k][parts[k].order[at[k]]])
        at[k] += 1
    for a, b, n in zip(row, row[1:], common[1:]):
        same = next((i for i in range(20) if a[i] != b[i]), 20)
        assert n == same // 2 * 2


def test_crowded_anchors_and_long_texts(spark, odd, monkeypatch):
    """Groups of two contents, slices of 97 windows and batches of a few rows give the same rows."""
    want = collections.Counter(tuple(r)[:5] for r in substrings.removed(odd, 50).collect())
    for name, value in (("PER_GROUP", 2), ("SLICE", 97), ("ROWS", 3), ("KNOWN", 2)):
        monkeypatch.setattr(substrings, name, value)
    assert want == brute_removed(texts(odd), 50) == collections.Counter(tuple(r)[:5] for r in substrings.removed(odd, 50).collect())


def test_packing_round_trip(odd, docs, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df, part in ((odd, 200_000), (docs, 200_000), (odd, 40)):
        monkeypatch.setattr(packing, "PART", part)  # long texts in parts
        got = packing.pack(df, with_ids=True).toPandas()
        want = collections.Counter()
        for d, t in texts(df):
            ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
            cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        have = collections.Counter((None if np.isnan(d) else int(d), k, s, n, c) for d, k, s, n, c in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
        assert have == want
        assert all(zlib.crc32(i) == c and len(i) == 4 * n for i, c, n in zip(got.ids, got.ids_crc32, got.length))
        for _, s in got.sort_values("offset").groupby("sequence_id"):
            assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 1024
        assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 1024) + 1
    assert packing.pack(odd.limit(0)).count() == 0


def test_fullest_combination():
    for _ in range(60):
        counts = {rnd.randrange(1, 30): rnd.randrange(1, 4) for _ in range(5)}
        room = rnd.randrange(1, 80)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
        got = packing.fullest(counts, room)
        assert sum(k * n for k, n in got.items()) == max(sums) and all(n <= counts[k] for k, n in got.items())


def test_wordpiece(odd, docs):
    pieces = wordpiece.vocabulary("byte_bpe_50k")
    known, most = set(pieces), max(map(len, pieces))

    def greedy(word):
        x, n, i = b" " + word, 0, 0
        while i < len(x):
            i += next(k for k in range(min(most, len(x) - i), 0, -1) if x[i : i + k] in known)
            n += 1
        return n

    for df in (odd, docs.limit(60)):
        want = collections.Counter((d, len((t or "").encode().split()), sum(map(greedy, (t or "").encode().split()))) for d, t in texts(df))
        assert collections.Counter(map(tuple, wordpiece.token_counts(df).collect())) == want
    tiny = wordpiece.Automaton([b" ", b"a", b"b", b"ab", b"abab", b" a"])
    assert tiny.count(b"abababb") == len([b" a", b"b", b"abab", b"b"]) and tiny.count(b"") == 1
    with pytest.raises(ValueError):
        wordpiece.Automaton([b" ab"]).count(b"a")


def test_budgets_go_to_siblings_first():
    have = {("x", "a"): 10, ("x", "b"): 100, ("y", "a"): 1000}
    got = mixing.budgets(have, {("x",): 0.5, ("y",): 0.5, ("x", "a"): 0.5, ("x", "b"): 0.5}, 160)
    assert got == {("x", "a"): 10, ("x", "b"): 70, ("y", "a"): 80}
    got = mixing.budgets(have, {("x",): 0.9, ("y",): 0.1}, 500)
    assert got[("x", "a")] + got[("x", "b")] == 110 and got[("y", "a")] == 390
    lost = mixing.budgets({("x", "a"): 10, ("x", "b"): 1000, ("y", "a"): 1000}, {("x",): 0.5, ("y",): 0.5, ("x", "a"): 1.0}, 400)
    assert sum(lost.values()) == 400 and lost[("x", "a")] == 10 and lost[("y", "a")] == 390
    assert mixing.budgets({}, {}, 10) == {(): 0} and sum(mixing.budgets(have, {}, 10**6, 2).values()) == 2220


def test_budgets_reach_every_leaf():
    w = {("web",): 0.5, ("books",): 0.3, ("forum",): 0.2} | {(d, x): v for d in ("web", "books", "forum") for x, v in {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}.items()}
    have = {("web", x, "s"): 10 for x in ("en", "de", "fr", "es")} | {("web", None, "s"): 1000, ("books", "en", "t"): 4000}
    got = mixing.budgets(have, w, 1000, 2, unnamed=0.05)
    assert sum(got.values()) == 1000 and got[("web", None, "s")] > 0 and got[("web", "en", "s")] == 20
    assert sum(mixing.budgets(have, w, 1000, 2).values()) == 1000 and sum(mixing.budgets(have, w, 10**6, 2).values()) == 2 * 5040
    # a language that is absent doesn't hand its share to the unnamed ones
    plenty = {("web", x, "s"): 10**6 for x in ("en", "de", "fr", None)}
    got = mixing.budgets(plenty, w, 105_000, unnamed=0.05)
    assert abs(got[("web", None, "s")] - 105_000 * 0.05 / 0.85) <= 3 and sum(got.values()) == 105_000
    # what the weighted leaves of a family lack goes to the parent's siblings, then to leaves without weight
    have = {("x", "a"): 100, ("x", "b"): 1000, ("y", "c"): 100}
    w = {("x",): 0.5, ("y",): 0.5, ("x", "a"): 1, ("x", "b"): 0}
    assert mixing.budgets(have, w, 180) == {("x", "a"): 90, ("x", "b"): 0, ("y", "c"): 90}
    assert mixing.budgets(have, w, 300) == {("x", "a"): 100, ("x", "b"): 100, ("y", "c"): 100}


def test_mixing(spark, odd):
    rows = [(i, "s" + str(i % 2), 10 + i % 7) for i in range(400)] + [(None, None, 5), (900, "s0", None), (901, "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, t long")
    run = lambda **k: mixing.mixed(df, {"source": F.col("source")}, F.col("t"), {("s0",): 0.7, ("s1",): 0.3}, 3000, seed=3, **k)
    got = run(max_epochs=2).toPandas()
    by = got.groupby("source").tokens_taken.sum()
    assert by.sum() == 3000 and abs(by["s0"] - 2100) <= 1 and got.duplicated(["doc_id", "epoch"]).sum() == 0
    full = dict((r[0], r[2]) for r in rows)
    assert (got.tokens_taken < got.doc_id.map(full)).sum() <= 3
    old = mixing.PER_RANGE
    try:
        mixing.PER_RANGE = 10  # many ranges give the same prefix
        again = run(max_epochs=2).toPandas()
    finally:
        mixing.PER_RANGE = old
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    assert mixing.mixed(df.limit(0), {"source": F.col("source")}, F.col("t"), {}, 10).count() == 0
    taken = mixing.mixed(odd, {"source": F.col("source"), "n": F.col("lang")}, F.char_length("text"), {}, 1.0).toPandas()
    assert taken.tokens_taken.sum() == sum(len(t or "") for _, t in texts(odd))
    out = mixing.resampled(odd, {"source": F.col("source")}, F.char_length("text"), {}, 1.0)
    assert out.columns == odd.columns and out.where("doc_id = 10").count() == 1 and out.where("doc_id = 4").count() == 0


@pytest.mark.parametrize("scale", [1024, 10**7])
def test_top_k(spark, scale):
    r = np.random.default_rng(3)
    x = r.normal(size=(700, 12)).round(3)
    x[100:300] = x[100]  # one very common vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)] + [(1000, None), (1001, [float("nan")] * 12), (1002, [1.0] * 11 + [None]), (1003, [1.0, 2.0]), (None, [1.0] * 12), (1100, [0.0] * 12), (1200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, scale=scale).collect()))
    whole = {i: np.floor(scale * np.array(v)).astype(np.int64) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    want = []
    for q in (i for i in [*whole, 1200] if i % 100 == 0 and i in whole):
        best = sorted((-int(whole[q] @ w), i) for i, w in whole.items() if i != q and len(w) == len(whole[q]))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_cover_tree_covers():
    x = np.random.default_rng(2).normal(size=(900, 8))
    todo = [topk.Node(x, np.arange(900))]
    while todo:
        n = todo.pop()
        assert np.linalg.norm(x[n.rows] - n.center, axis=1).max() <= n.radius + 1e-9
        if n.children:
            assert sorted(np.concatenate([c.rows for c in n.children])) == sorted(n.rows)
        todo += n.children


def test_html(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extracted(pages).collect():
        article = re.search("<article>(.*?)(</article>|$)", raw[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split()) and r.n_chars == len(r.text)
        # without that element the blocks' measures alone give the same
        assert html_text.main_text(re.sub("(</?)article>", r"\1div>", raw[r.page_id])) == r.text
    assert html_text.extracted(pages.limit(0)).count() == 0
    page = """<html><body><div id="menu"><a href=x>Home</a></div><div class="cookie-notice">We use cookies to make it better for the users of the site.</div>
    <div><h1>Big title</h1><p>This is a long paragraph of the text that is in the page and it has a lot of stop words in it for the rule.</p><p>Short&nbsp;one &lt;b&gt;.</p>
    <script>var a = "<p>no</p>"</script></div><div class=comments><p>I am a reader and this is the best thing that I have read in all of my life, thank you.</p></div><form>Mail</form><footer>&copy; all</footer>"""
    assert html_text.main_text(page) == "Big title This is a long paragraph of the text that is in the page and it has a lot of stop words in it for the rule. Short one <b>."
    assert html_text.main_text("<div class=post><p>Read <a href=x>this</a> now and see what we have in the house of the man.</p></div>").startswith("Read this now")
    assert html_text.main_text("<p class='share-price'>The price of it is up.</p><article><header><h1>Title</h1></header><p>Short.</p></article><div class='site-footer'>x</div>") == "The price of it is up. Title Short."
    long = "<p>" + "the man of the house is in it and " * 20 + "</p>"
    assert html_text.main_text("<html>" + long * 500) == " ".join(["the man of the house is in it and " * 20] * 500).replace("  ", " ").strip()
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == html_text.main_text("<!-- open") == "" and html_text.main_text("a < b") == "a < b"
    assert [html_text.is_mark(x) for x in ("ad", "ad-banner", "site-footer", "cookie-notice", "sidebar2", "share-price", "post-footer", "main-content", "")] == [True] * 5 + [False] * 4
    odd = spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>x", 2), (1, None, None, 1)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extracted(odd).collect()) == [(0, "x"), (1, ""), (1, "")]


def base(t):
    t = t or ""
    w = WORD.findall(t)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_rules(odd, docs):
    for df in (odd, docs):
        got = collections.Counter(tuple(r)[:7] for r in quality_rules.judged(df).collect())
        assert got == collections.Counter((d, *base(t)) for d, t in texts(df))
    assert all(not r.kept for r in quality_rules.judged(odd).where("base_failed").collect())
    assert quality_rules.judged(odd.limit(0)).count() == 0


def determinant_minimum(x):
    """Mean and covariance of the rows by the same starts and steps in numpy; quarters by whole bins of distances."""
    floors = np.array(list(quality_rules.FLOORS.values())) ** 2

    def nearest(d):
        bins = np.floor(16 * np.log2(1 + 16 * d))
        kept = np.sort(bins)[int(np.ceil(quality_rules.SHARE * len(d))) - 1]
        return x[bins <= kept]

    def estimate(rows):
        return rows.mean(0), quality_rules.FACTOR * np.cov(rows.T, bias=True) + np.diag(floors)

    def far(mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    middle = np.sort(x, 0)[int(np.ceil(len(x) / 2)) - 1]
    spread = np.sort(np.abs(x - middle), 0)[int(np.ceil(len(x) / 2)) - 1]
    z = (x - middle) ** 2 / ((1.4826 * spread) ** 2 + floors)
    found = []
    for d in (z.sum(1), z.max(1), far(*estimate(x))):
        now = estimate(nearest(d))
        for _ in range(quality_rules.STEPS):
            now = estimate(nearest(far(*now)))
        found.append((np.linalg.det(now[1]), now))
    return min(found, key=lambda f: f[0])[1]


def test_outliers_like_numpy(spark):
    """The estimate against the same in numpy; a planted fifth of outliers is rejected."""
    r = np.random.default_rng(4)
    clean = np.c_[r.normal(6, 0.5, 400), r.normal(1.6, 0.4, 400), np.abs(r.normal(0, 0.2, (400, 3)))]
    bad = np.c_[r.normal(6, 0.5, 120), r.normal(4.5, 0.2, 120), r.normal(4, 0.3, 120), np.abs(r.normal(0, 0.2, (120, 2)))]
    x = np.concatenate([clean, bad])
    names = quality_rules.NAMES
    df = spark.createDataFrame([("k", *map(float, v)) for v in x], "key string, " + ", ".join(f"{n} double" for n in names))
    p = quality_rules.estimates(df).first()
    mean, cov = determinant_minimum(x)
    assert np.allclose([p[f"m_{n}"] for n in names], mean, atol=0.01)
    assert np.allclose([p[f"c_{i}_{j}"] for i in range(5) for j in range(i + 1)], [cov[i, j] for i in range(5) for j in range(i + 1)], atol=0.01)
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    assert (d[400:] > quality_rules.CUTOFF).all() and (d[:400] <= quality_rules.CUTOFF).mean() > 0.99


def test_verdicts_like_numpy(spark, docs):
    """kept of every document, from its statistics, estimates and shrinkage in numpy."""
    import pandas as pd

    got = quality_rules.judged(docs).toPandas().merge(docs.select("doc_id", "lang", "source").toPandas(), on="doc_id")
    f = got[~got.base_failed].copy()
    log = np.log(f.word_chars / f.n_words)
    median = lambda v: np.sort(v)[int(np.ceil(len(v) / 2)) - 1]
    f["usual"] = pd.Series(log).groupby([f.lang, f.source]).transform(median)
    n = f.n_words
    x = np.c_[np.log(n), (log - f.usual) * np.sqrt(np.minimum(n, 400) / 40), np.log1p(20 * f.n_symbols / n), np.log1p(5 * f.n_dup_lines / np.sqrt(n)), np.log1p(10 * f.n_repeat_words / n)]
    k = quality_rules.SHRINK
    whole, langs, seen, want = determinant_minimum(x), {}, {}, np.zeros(len(f), bool)
    mix = lambda own, pool, n: tuple(n / (n + k) * a + k / (n + k) * b for a, b in zip(own, pool))
    for lang in f.lang.unique():
        own = x[(f.lang == lang).to_numpy()]
        langs[lang] = mix(determinant_minimum(own), whole, len(own))
    for i, (lang, source) in enumerate(zip(f.lang, f.source)):
        if (lang, source) not in seen:
            own = x[((f.lang == lang) & (f.source == source)).to_numpy()]
            seen[lang, source] = mix(determinant_minimum(own), langs[lang], len(own))
        mean, cov = seen[lang, source]
        want[i] = (x[i] - mean) @ np.linalg.inv(cov) @ (x[i] - mean) <= quality_rules.CUTOFF
    assert (f.kept.to_numpy() == want).mean() > 0.99 and not got[got.base_failed].kept.any()


def test_many_groups_are_joined_by_key(spark, docs, monkeypatch):
    """Beyond the bound of the broadcast the verdicts stay; large keys, here the one of all, are still sent to every task."""
    want = {r.doc_id: r.kept for r in quality_rules.judged(docs).collect()}
    monkeypatch.setattr(quality_rules, "BROADCAST", 0)
    monkeypatch.setattr(quality_rules, "LARGE", 0.2)
    assert {r.doc_id: r.kept for r in quality_rules.judged(docs).collect()} == want


def test_junk_among_clean_texts_is_rejected(spark):
    """A symbol in every second to fourth word of a text that is like its group otherwise, and repeats just within the base."""
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("abcdefghij"), r.integers(2, 9)))
    clean = [[word() for _ in range(r.integers(60, 240))] for _ in range(200)]
    junk = [[w + "#" * (i % k == 0) for i, w in enumerate(t)] for k in (2, 3, 4) for t in [[word() for _ in range(120)] for _ in range(5)]]
    copied = [t + t[:11] for t in [[word() for _ in range(120)] for _ in range(3)]]
    df = spark.createDataFrame([(i, " ".join(t), "en", "s") for i, t in enumerate(clean + junk + copied)], "doc_id long, text string, lang string, source string")
    kept = {x.doc_id for x in quality_rules.judged(df).where("kept").collect()}
    assert not kept & set(range(200, 218))
    assert len(kept) >= 196
    assert not quality_rules.judged(df).where("doc_id >= 200 and base_failed").head(1)


def test_fit_takes_every_passage(spark, monkeypatch):
    """Bags of 60 passages of which one in the middle is bad: all of them reach the fit, in blocks as at once."""
    seen = []
    plain = quality_model.Attention.fit

    def fit(self, x, count, y):
        seen.append((np.array(x), count, y))
        return plain(self, x, count, y)

    monkeypatch.setattr(quality_model.Attention, "fit", fit)
    good = "some words of a text that is plain and clean, all of it. " * 421
    rows = [(i, good[:12000] + "#$% " * 100 * (i % 2) + good[:11600]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    a = quality_model.fit(docs, labels)
    monkeypatch.setattr(quality_model, "ROWS", 200)
    b = quality_model.fit(docs, labels)
    x, count, y = seen[0]
    texts = dict(rows)
    order = [r.doc_id for r in docs.where(~quality_model.held_out(F.col("doc_id"))).orderBy("doc_id").collect()]
    whole, n = quality_model.encode([texts[i].encode() for i in order])
    assert (count == n).all() and count.max() > 24 and np.array_equal(x, whole)
    assert [round(float(v)) for v in a.forward(whole, n)[0]] == list(y)
    assert np.allclose(a.forward(whole, n)[0], b.forward(whole, n)[0], atol=0.05)


def test_classifier_on_held_out_rows(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_model.classified(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in held.doc_id]).all() and ((held.predicted == 1) == (held.score >= 0.7)).all()
    assert (held.predicted == held.quality).mean() >= 0.95
    shuffled = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    a, b = (quality_model.score(d, quality_model.fit(docs, labels)).orderBy("doc_id").toPandas() for d in (docs, shuffled))
    assert np.allclose(a.score, b.score)
    none = quality_model.classified(odd, labels.limit(0)).toPandas()
    assert len(none) == len(ROWS) and (none.score == 0.5).all()
    model = quality_model.fit(docs, labels)
    assert quality_model.score(odd, model).count() == len(ROWS) and quality_model.score(odd.limit(0), model).count() == 0
    assert quality_model.accepted(odd, labels).columns == odd.columns
    messy = labels.union(spark.createDataFrame([(1, None, None), (2, 5, 0), (None, 1, 0)], labels.schema))
    assert quality_model.classified(docs.limit(20), messy).count() == 20


def test_attention_gradients():
    r = np.random.default_rng(0)
    x, count, y = r.normal(size=(30, 6)), np.array([3, 7, 10, 10]), np.array([0.0, 1, 1, 0])
    model = quality_model.Attention(x.mean(0), x.std(0))
    before = model.forward(x, count)[0]
    after = model.fit(x, count, y).forward(x, count)[0]
    loss = lambda p: -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    assert loss(after) < 0.5 * loss(before) and np.allclose(np.add.reduceat(model.forward(x, count)[1][4], np.cumsum(count) - count), 1, atol=1e-5)


def own_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)(/[^?#]*)?", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2] or "") if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)] if m else []
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/1?x=/de/", "https://example.org/en/12", "https://notexample.org/en/1", "ftp://x.com/de/a#b", "http://com/de/", "http://www.x.com/fr", "nothing", "", None, "http://", "a://b?c://d/e", "https://x.com/fr/?q", "http://example.org#/es/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 2)] + [(None, "http://x.net/")], "page_id long, url string").withColumn("rule", F.lit("mine"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_filter.judged(pages, labels)
    want = collections.Counter((i, *own_rule(u)[:3], own_rule(u)[3] or "allow") for i, u in [*enumerate(urls * 2), (None, "http://x.net/")])
    assert collections.Counter(tuple(r)[:5] for r in got.collect()) == want
    assert url_filter.judged(pages.limit(0), labels).count() == 0


def test_mined_url_rules(spark):
    rows = [(i, f"http://{'bad-farm' if i % 4 == 0 else 'fine'}{i % 5}.example.net/{'en' if i % 3 else 'de'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(0, 300)] + [(399, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_filter.judged(pages, labels).collect()}
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(300, 400))


def test_mined_rules_like_brute_force(spark):
    """All rules of any length by enumeration: a token that every page has, one rule of four tokens, pages without tokens."""
    import itertools

    local = random.Random(8)
    rows = []
    for i in range(240):
        t = {"u"} | {x for x in "abcd" if local.random() < 0.6} if i % 12 else set()
        label = 0 if {"a", "b", "c", "d"} <= t else int(local.random() < 0.7)
        rows.append((sorted(t), label))
    support, confidence = 0.05, 0.6
    least = -(-len(rows) * support // 1)
    want = {}
    for k in range(1, 6):
        for items in itertools.combinations("abcdu", k):
            with_ = [y for t, y in rows if set(items) <= set(t)]
            for label, verdict in ((0, "block"), (1, "allow")):
                n = sum(y == label for y in with_)
                if n >= least and n / len(with_) >= confidence:
                    want[items, verdict] = n / len(with_)
    want = {(i, v): c for (i, v), c in want.items() if not any(v == w and set(j) < set(i) and d >= c for (j, w), d in want.items())}
    got = url_filter.mined(spark.createDataFrame(rows, "tokens array<string>, label int"), support, confidence).collect()
    assert {(tuple(r["items"]), r.verdict): round(r.confidence, 9) for r in got} == {k: round(c, 9) for k, c in want.items()}
    assert any(len(i) == 4 for i, _ in want) and (("u",), "allow") in want


def test_blocks_are_pruned_before_rows_are_sent(spark):
    """Planted clusters: four times the rows send far less than sixteen times the pairs."""
    sent = []
    plain = topk._sent

    def counted(data, pairs):
        out = plain(data, pairs)
        sent[-1] += out.count()
        return out

    def run(n):
        r = np.random.default_rng(1)
        centers = r.normal(size=(20, 16)) * 10
        rows = [(i, [float(v) for v in centers[i % 20] + r.normal(size=16) * 0.1]) for i in range(n)]
        sent.append(0)
        topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).count()

    try:
        topk._sent, topk.BLOCK, topk.GROUP, old = counted, 64, 16, (topk.BLOCK, topk.GROUP)
        run(500)
        run(2000)
    finally:
        topk._sent, topk.BLOCK, topk.GROUP = plain, *old
    assert sent[1] < 8 * sent[0]


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in pipeline.STAGES:
        docs = out[name] = stage(spark, docs, sf).cache()
    given = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(out[n].columns == given for n, _ in pipeline.STAGES[:-1])
    ids = lambda n: [r.doc_id for r in out[n].select("doc_id").collect()]
    near = dict((d, c) for d, _, c in brute_components(texts(out["quality"]), 5, 80))
    assert sorted(ids("near_duplicates")) == sorted(d for d, c in near.items() if d == c)
    seen = brute_removed(texts(out["near_duplicates"]), 100)
    assert {d for d, n, gone, _, _ in seen if gone < n} <= set(ids("repeated_passages"))
    assert set(ids("mix")) <= set(ids("repeated_passages")) and max(collections.Counter(ids("mix")).values()) <= 2
    assert sum(r.length for r in out["pack"].collect()) == sum(packing.pieces(out["mix"]).select("length").toPandas().length)


def test_token_counts_of_columns_and_names(spark):
    """A column of counts takes bytes, no pandas strings, and gives what the operator counts: null, empty, blank and odd texts too."""
    texts = [None, "", " \t\n", "a  bc\x0bd", "é中  x", "z" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.n_tokens for r in wordpiece.token_counts(df).collect()}
    for column in ("text", F.col("text")):
        counted = df.select("doc_id", wordpiece.n_tokens(column).alias("n"))
        assert {r.doc_id: r.n for r in counted.collect()} == want and want[0] == want[1] == want[2] == 0
        assert "cast(text" in counted._jdf.queryExecution().toString().lower()


def test_fragments_come_once(spark, odd):
    """An occurrence is one row, with its content or without."""
    kept = spark.sparkContext.broadcast(substrings.ids(odd.where("doc_id is not null"), "doc_id"))
    found = substrings._fragments(odd, 50, b"\xff" * (1 << 19), kept).toPandas()
    assert len(found) and not found.place.isna().any() and not found.duplicated(["doc_id", "place"])[found.doc_id != 13].any()
    assert found[found.content.notna()].cid.nunique() == found.cid.nunique() and (found.content.notna() == found.shard.notna()).all()


def test_two_symbols_at_a_time_merge_alike():
    contents = [bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(60, 90))) + b"the same end of forty bytes or of some more" for _ in range(30)]
    for length in (50, 52):
        parts = [substrings.Shard(contents[k::4], length) for k in range(4)]
        (one, common), (two, wide) = substrings.merged(parts, length), substrings.merged(parts, length, wide=True)
        assert (one == two).all() and ((common < length) == (wide < length)).all() and (common // 4 * 4 < common).any()


def test_kept_texts_are_cut_once(odd):
    """A filter and the length read the cut text, too."""
    left = substrings.without_repeats(odd, 50)
    assert left._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_mixing_counts_each_text_once(spark):
    import pyarrow as pa

    seen = spark.sparkContext.accumulator(0)

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        seen.add(len(texts))
        return pa.array([len(t.as_py() or "") for t in texts], pa.int64())

    df = spark.createDataFrame([(i, "s", "x" * (i % 5)) for i in range(60)], "doc_id long, source string, text string")
    got = mixing.mixed(df, {"source": F.col("source")}, tokens("text"), {}, 1.0).toPandas()
    assert seen.value == 60
    assert len(got) == 48 and got.tokens_taken.sum() == 120
