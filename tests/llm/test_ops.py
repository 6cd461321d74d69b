"""The operators' parts against plain versions."""

import hashlib
import io
import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from factweave.llm import op1_html, op2_quality, op3_linechunks, op4_media, op5_sentencepiece, op6_simhash, op7_langid, op8_repetition, op9_lm, op10_mixing


# op1
def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice"><p>We use cookies, and so on, and a long sentence follows.</p></div><div id="main"><article><h1>Title &amp; more</h1><p>First paragraph, with commas, long enough to count.
    <p>Second&nbsp;one<br>goes   on, and on, and on, for long enough.</p><form><p>Sign up, please, to our long newsletter, now.</p></form><div class="comments"><p>Nice text, thanks, I liked it a lot.</p></div></article></div>
    <aside><p>Other text, also long, also with commas, to mislead.</p></aside><!-- <p>hidden, hidden, hidden, hidden, hidden</p> --><script>"<p>no</p>"</script><footer><p>Imprint, address, and a long legal text.</p></footer></body></html>"""
    assert op1_html.main_text(page) == "Title & more\nFirst paragraph, with commas, long enough to count.\nSecond one goes on, and on, and on, for long enough."


def test_pages_without_article():
    body = "".join(f"<p>Paragraph {i}, which is long enough, and has commas.</p>" for i in range(5))
    page = f"<body><div class=menu><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div><div class=post>{body}</div><div class=ad>Buy, buy, buy, it is cheap, really cheap.</div></body>"
    assert op1_html.main_text(page).count("\n") == 4 and "Buy" not in op1_html.main_text(page)


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</p></p>", "<div " + "a" * 10, "&#x110000;&bogus;", "<a><b><c></a></b>"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(op1_html.main_text(page), str)


def test_deep_pages():
    assert op1_html.main_text("<div>" * 20_000 + "deep text") == "deep text"
    assert op1_html.main_text("a < b &lt; c") == "a < b < c"


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ('<p class="byline">By A. Writer</p>', "By A. Writer"), ('<div class="meta">A long line of prose, with commas, stands here.</div>', "A long line of prose, with commas, stands here."),
        ('<p class="entry hidden-gem">A hidden gem of a place.</p>', "A hidden gem of a place."), ("<p>Let <math><mi>x</mi></math> be given.</p>", "Let x be given."), ("<script src=/a/>var x=1, y=2;</script>", None), ("<p>a<script src='b'/>c, d</script>e</p>", "ae"),
        ("<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul>", "One\nTwo\nThree"),
    ],
)
def test_nothing_else_goes(inside, text):
    """Only what the contract names is left out of an article."""
    p = "<p>A paragraph, long enough, with commas, to be the main text of it.</p>"
    got = op1_html.main_text(f"<body><nav><a href=x>Home</a></nav><article>{p}{inside}{p}</article></body>").split("\n")
    assert "\n".join(got[1:-1]) == (text or "") and got[0] == got[-1]


PROSE = "".join(f"<p>A long plain paragraph number {i}, with some words in it and a full stop at its end.</p>" for i in range(5))


@pytest.mark.parametrize(
    ("page", "first", "n"),
    [
        (f'<main><div class="layout with-sidebar">{PROSE}</div></main>', "A long", 5), (f'<article><h1>Title</h1><div class="entry no-ads">{PROSE}</div></article>', "Title", 6), (f'<article><h1>T</h1>{PROSE}<section class="discussion">{PROSE}</section></article>', "T", 11),
        (f'<article><div class="post-header"><h1>Title</h1><span>12 May</span></div>{PROSE}</article>', "Title", 6), (f'<article>{PROSE}<p class="promotion-history">The history of the promotion of this thing is long, and it is told here in full.</p></article>', "A long", 6),
        (f'<div class="left">{PROSE}</div><article class="teaser"><p>A teaser text of some length stands here, with a comma.</p></article>', "A long", 5), (f'<main><div class="sidebar-layout">{PROSE}</div></main>', "A long", 5),
        (f'<article>{PROSE}<div class="comments">{PROSE * 4}</div></article>', "A long", 5), (f'<article>{PROSE}<div class="sidebar">{PROSE}</div><p class="ad">Buy this, buy that, and buy it all, right now.</p></article>', "A long", 5),
    ],
)
def test_class_words_are_hints(page, first, n):
    """A word of a class drops neither most of an article nor a paragraph whose class says more; comments, sidebars and adverts still go."""
    got = op1_html.main_text(f"<body><nav><a href=x>Home</a></nav>{page}</body>").split("\n")
    assert got[0].startswith(first) and len(got) == n


def test_time_is_linear_in_the_page():
    began = time.time()
    n = 100_000
    op1_html.main_text("<b>" * n + "x<hr>" * n)
    op1_html.main_text("<b><table>" + "<i>" * n + "</b>x" * n)
    assert time.time() - began < 30


# op2
def test_ordinal_fit_learns_grades():
    rng, rows, grades = random.Random(1), [], []
    f = op2_quality.Features()
    for _ in range(600):
        g = rng.choice([0, 1, 2, 2, 2])
        words = [rng.choice("lorem ipsum dolor sit amet magna aliqua".split()) for _ in range(40)] + ["bad"] * (g < 2) + ["worse"] * (g < 1)
        rng.shuffle(words)
        rows.append(f(" ".join(words)))
        grades.append(g)
    grades = np.array(grades)
    m = op2_quality.fit(rows, grades)
    tails = m.tails(np.array([m.weights[r].sum() for r in rows]))
    assert (np.diff(m.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails > 0.5).sum(1) == grades).mean() > 0.97


# op3
def test_units_cover_the_text():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", ". ", "! ", "\n", " ", "", "é"]) for _ in range(rng.randint(0, 30)))
        u = op3_linechunks.units(text)
        assert "".join(text[a:c] for a, _, c in u) == (text[u[0][0] :] if u else "") or not u
        assert op3_linechunks.without(text, []) == (text, 0)
        assert op3_linechunks.pieces(text)[0] == [text[a:b].strip() for a, b, _ in u]


def test_shared_passage_is_found_whatever_surrounds_it():
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(8)) + "."
    found = by_boundaries = 0
    for _ in range(100):
        passage = [line() for _ in range(8)]
        hashes = []
        for _ in range(2):
            own = [line() for _ in range(rng.randint(1, 5))] + passage + [line() for _ in range(rng.randint(1, 5))]
            h, _, a, b = op3_linechunks.chunks([(own, [True, *[False] * (len(own) - 1)])])
            hashes.append((set(h.tolist()), set(h[b - a > 2].tolist())))
        found += bool(hashes[0][0] & hashes[1][0])
        by_boundaries += bool(hashes[0][1] & hashes[1][1])  # chunks that only the rolling hash makes
    assert found == 100 and by_boundaries >= 70


def test_short_passages_go_whole(spark):
    """Against all runs of units, listed one by one."""
    rng = random.Random(4)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)) + "."
    passages = [[line(rng.choice([3, 6, 12])) for _ in range(k)] for k in (2, 3, 4, 5) for _ in range(6)] + [[line(30)], [line(12)]]
    tiny = [[line(1) for _ in range(k)] for k in (2, 3, 4)]
    docs = []
    for i in range(80):
        parts = [x for _ in range(rng.randint(0, 3)) for x in ([[line(9)]] * rng.randint(0, 2) + [rng.choice(passages + tiny)])]
        docs.append((i, "".join(x + (rng.choice([" ", "\n"]) if p not in tiny and x is not p[-1] else "\n") for p in parts for x in p)))
    seen, want = set(), {}
    for i, text in docs:
        u = [(x, j == 0) for l in text.split("\n") for j, x in enumerate(l.replace(". ", ".\n").split("\n")) if x.strip()]
        gone = set()
        for a in range(len(u)):
            for b in range(a + 1, len(u) + 1):
                n = sum(len(x.split()) for x, _ in u[a:b])
                if (b - a >= 2 and (n >= 10 or any(o for _, o in u[a + 1 : b]))) or n >= 25:
                    run = tuple(x for x, _ in u[a:b])
                    gone |= set(range(a, b)) if run in seen else set()
                    seen.add(run)
        want[i] = [x for j, (x, _) in enumerate(u) if j not in gone]
    got = {r.doc_id: op3_linechunks.pieces(r.text)[0] for r in op3_linechunks.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and sum(len(op3_linechunks.pieces(t)[0]) for _, t in docs) > sum(map(len, want.values())) + 100


def test_short_lines_and_repeated_ids(spark):
    """A block of two lines and six words goes from all but one of 20 documents; rows with one id and other texts are two documents."""
    docs = [(i % 19, f"own text {i} here\nshort line one\nshort line two\nend {i}") for i in range(20)]
    rows = op3_linechunks.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == 20 and sum("short" in r.text for r in rows) == 1 and all("own text" in r.text and "end" in r.text for r in rows)


def test_cover():
    rng = random.Random(5)
    for _ in range(200):
        spans = [(a, a + rng.randint(1, 4), i) for i, a in enumerate(rng.choices(range(15), k=rng.randint(0, 12)))]
        out = op3_linechunks.cover(spans)
        units = lambda s: {u for a, b, _ in s for u in range(a, b)}
        assert units(out) == units(spans) and set(out) <= set(spans) and len(out) <= len(spans)


# op4
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_text_as_image(n):
    text = bytes(i * 7 % 256 for i in range(n))
    r = op4_media.stored_text(text)
    payload = text + bytes(-n % 64 if n else 64)
    assert (r["n_bytes"], r["payload_bytes"]) == (n, len(payload)) and len(payload) % 64 == 0 and payload
    assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])


def test_images_round_trip():
    rng = np.random.default_rng(0)
    grey, rgb = rng.integers(0, 256, (5, 7), dtype=np.uint8), rng.integers(0, 256, (6, 5, 3), dtype=np.uint8)
    assert (op4_media.decode(op4_media.encode_bmp(grey)) == grey).all() and (op4_media.decode(op4_media.encode_bmp(rgb)) == rgb).all()
    assert (op4_media.decode(b"P5 # c\n7 5\n255\n" + grey.tobytes()) == grey).all() and (op4_media.decode(b"P6\n5 6\n255\n" + rgb.tobytes()) == rgb).all()
    assert (op4_media.decode(b"P2\n7 5\n255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    assert op4_media.decode(b"P1\n3 1\n101").tolist() == [[0, 1, 0]] and op4_media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 1, 0]]
    for broken in (b"", b"P5", b"P5\n9 9\n255\nxx", b"BM", b"GIF"):
        with pytest.raises(Exception):  # noqa: B017
            op4_media.decode(broken)


def test_area_resize_is_the_mean_of_areas():
    image = np.random.default_rng(1).random((11, 13))
    fine = np.kron(image, np.ones((8, 9)))
    want = fine.reshape(8, 11, 9, 13).mean((1, 3))
    assert np.allclose(op4_media.area_resize(image, 8, 9), want)
    assert np.load(io.BytesIO(op4_media.npy_tile((image * 255).astype(np.uint8)))).shape == op4_media.TILE


# op5
@pytest.fixture(scope="module")
def encoder():
    return op5_sentencepiece.load()


def test_round_trips(encoder):
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(["a", "the", " ", "  ", "\n", "▁", "é", "漢", "😀", chr(rng.randint(1, 0xD7FF))]) for _ in range(rng.randint(0, 20)))
        assert encoder.decode(encoder.encode(text)) == text


def test_best_path_equals_trying_all(encoder):
    rng = random.Random(5)
    known = {p: encoder.scores[i] for i, (p, _, k) in enumerate(encoder.pieces) if k == 1}

    def best(text):
        top = [0.0] + [-math.inf] * len(text)
        for i, j in itertools.combinations(range(len(text) + 1), 2):
            s = known.get(text[i:j], encoder.unknown_score if j == i + 1 else -math.inf)
            top[j] = max(top[j], top[i] + s)
        return top[-1]

    for _ in range(200):
        text = "▁" + "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 10)))
        assert math.isclose(sum(encoder.scores[i] for i in encoder.best(text)), best(text), abs_tol=1e-6)


def test_double_array():
    keys = [(w.encode(), i) for i, w in enumerate(["a", "ab", "abc", "b", "ü", "zz"])]
    t = op5_sentencepiece.DoubleArray(keys)
    assert list(t.matches(b"abcd", 0)) == [(1, 0), (2, 1), (3, 2)] and list(t.matches("xü".encode(), 1)) == [(3, 4)] and list(t.matches(b"q", 0)) == []


# op6
def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("text", ["", " \n", "One", "one two", "A b C", "É é x\ty\x0bz w", "a b c d e f g " * 50])
def test_fingerprints(text):
    assert op6_simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_components_equal_all_pairs(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(25):  # chains and clouds
            x = (x if rng.random() < 0.5 else b) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x), i) for i, x in enumerate(fps)], "fp long, first long")
    got = {r.fp: r.least for r in op6_simhash.components(op6_simhash.links(nodes.select("fp")), nodes).collect()}
    want = {}
    for i, x in enumerate(fps):
        want.setdefault(find(x), i)
    assert all(got.get(signed(x), i) == want[find(x)] for i, x in enumerate(fps))


def test_crowded_cells_equal_all_pairs(spark):
    """Clouds, chains and exact neighbours in large numbers; every grid is reached, and a rerun gives the same."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, np.uint64)
    flips = lambda n, k: np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (n, k)).astype(np.uint64), axis=1)
    clouds = [centres[rng.integers(0, 40, 2500)] ^ flips(2500, k) for k in (1, 2, 3)]
    chain = np.bitwise_xor.accumulate(np.concatenate([centres[:1], flips(300, 2)]))
    fps = np.unique(np.concatenate([centres, *clouds, chain, rng.integers(0, 1 << 63, 3000, np.uint64)]))
    root = np.arange(len(fps))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2) + i + 1:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(int(x), i) for i, x in enumerate(fps.view(np.int64))], "fp long, first long")
    found = op6_simhash.links(nodes.select("fp"))
    got = {r.fp: r.least for r in op6_simhash.components(found, nodes).collect()}
    assert all(got.get(int(x), i) == find(i) for i, x in enumerate(fps.view(np.int64))) and found.count() < 40 * len(fps)
    again = {r.fp: r.least for r in op6_simhash.components(op6_simhash.links(nodes.select("fp").repartition(7)), nodes).collect()}
    assert got == again


def test_repeated_ids_of_other_texts_stay(spark):
    docs = [(1, "one text of its own"), (1, "other text under one id"), (2, "one text of its own"), (1, "one text of its own"), (None, "one text of its own")]
    rows = op6_simhash.one_per_group(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, docs[0][1]), (1, docs[0][1]), (1, docs[1][1])]


def test_stage_links_similar_texts(spark):
    """Pairs of documents with some words changed, against the exact similarity; repeated ids of other texts stay."""
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    docs, twins, near = [(1, "one text of its own"), (1, "other text under one id")], 0, 0
    for i in range(60):
        w = words(200)
        v = list(w)
        for at in rng.sample(range(200), rng.choice([1, 3, 40])):
            v[at] = words(1)[0]
        x, y = (set(zip(*(z[k:] for k in range(5)), strict=False)) for z in (w, v))
        near += len(x & y) / len(x | y) >= 0.8
        twins += 1
        docs += [(10 + 2 * i, " ".join(w)), (11 + 2 * i, " ".join(v))]
    got = op6_simhash.one_of_similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert near > 20 and len(got) == len(docs) - near and {r.text for r in got if r.doc_id == 1} == {docs[0][1], docs[1][1]}


def test_stage_groups_equal_all_pairs(spark):
    """Pairs among many texts of one origin, which share their buckets with texts that are not similar enough; frequent shingles as well."""
    rng = random.Random(4)
    changed = lambda w, n: [("x%d" % rng.getrandbits(30)) if i in at else x for at in [set(rng.sample(range(len(w)), n))] for i, x in enumerate(w)]
    base = ["w%d" % rng.getrandbits(30) for _ in range(200)]
    texts = [v for _ in range(200) for w in [changed(base, 3)] for v in (w, changed(w, 4))] + [["a"] * n for n in (3, 5, 9)] + [list("abcdefgh"[:n]) for n in (5, 7, 8)] + [[]]
    sets = [set(zip(*(w[k:] for k in range(5)), strict=False)) or {tuple(w)} for w in texts]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component.doc_id for r in op6_simhash.similar(docs, 5, 0.8).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


# op7
def test_viterbi_equals_trying_all():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, k = rng.integers(1, 7), rng.integers(1, 4)
        s, w = rng.normal(size=(n, k)) * 3, rng.uniform(0, 4)
        value = lambda p: sum(s[i, j] for i, j in enumerate(p)) - w * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert math.isclose(value(list(op7_langid.viterbi(s, w))), max(map(value, itertools.product(range(k), repeat=int(n)))), abs_tol=1e-9)


def test_scripts_and_letters():
    assert [op7_langid.script(w) for w in ("abc", "ж", "漢", "ñ", "א", "ꙮ")] == ["Latin", "Cyrillic", "Han", "Latin", "Hebrew", "Other"]
    assert op7_langid.letters("Don't-4") == "dont" and op7_langid.letters("½①²") == ""


def test_every_language_is_learned(spark):
    rng = random.Random(10)
    docs = [(10 * i + j, " ".join("".join(rng.choice(chr(0x100 + i) + chr(0x101 + i) + "ab") for _ in range(6)) for _ in range(30)), f"l{i}") for i in range(230) for j in range(2)]
    df = spark.createDataFrame([*docs, (9999, "½ ①", "l0"), (9998, "", None), (9997, None, "l1")], "doc_id long, text string, lang string")
    m = op7_langid.learn(df)
    rows = op7_langid.identify(df, m, op7_langid.F.lit(False)).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(m.langs) == 230 and sum(got[d][0] == l for d, _, l in docs) >= 0.9 * len(docs)
    assert got[9999] == got[9998] == got[9997] == ("und", 0.0)
    assert [op7_langid.bucket_bits(n) for n in (1, 256, 257, 5000, 10**6)] == [16, 16, 15, 11, 10]


# op8
@pytest.mark.parametrize("text", ["", "a b c", "x y z x y z", "a a a a a", "l1 a\nl1 a\nl2\n\n\nl1 a", "é ü # $ é ü # $", "a b c d " * 40])
def test_repetition_counts(text):
    words = text.encode().split()
    n = len(words)
    c = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    cover = set()
    for i in range(n - 2):
        if c[tuple(words[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if x.strip()]
    r = op8_repetition.measure(text.encode())
    assert r["n_repeat_words"] == len(cover) and r["n_words"] == n and r["n_dup_lines"] == len(lines) - len(set(lines))
    assert r["word_chars"] == sum(len(w.decode()) for w in words) and r["n_symbols"] == sum(x in "#*$%&|<>" for x in text)
    assert r["base_failed"] == (n < 50 or 100 * len(cover) > 50 * n)
    for k in op8_repetition.LIMITS:
        seen, later = set(), set()
        for i in range(n - k + 1):
            g = tuple(words[i : i + k])
            later |= set(range(i, i + k)) if g in seen else set()
            seen.add(g)
        assert math.isclose(r["shares"][k], sum(len(words[i].decode()) for i in later) / max(r["word_chars"], 1))


# op9
def test_automaton_is_a_distribution(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a b", "a c", "b a c", "c", "d e f"]) for _ in range(40)) for _ in range(30)]
    m = op9_lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    c = Counter(w for t in texts for w in op9_lm.tokens(t.encode()))
    hot, width = m.hot, len(m.hot.word)
    assert m.total == sum(c.values()) and m.distinct == len(c) == width and len(hot.arc) > 5 and hot.fail.max() > 0 and m.cold.count() == 0
    arcs = {(int(a) // width, int(a) % width): i for i, a in enumerate(hot.arc)}

    def step(state, word):
        """One token of the plain traversal: what it adds, and the state after it."""
        added = 0.0
        while (i := arcs.get((state, word))) is None and state:
            added, state = added + hot.weight[state], hot.fail[state]
        return (added + hot.value[i], hot.after[i]) if i is not None else (added + hot.logs[word], hot.start[word])

    for state in range(len(hot.fail)):
        lp, s = 0.0, state
        while s:
            lp, s = lp + hot.weight[s], hot.fail[s]
        assert math.isclose(sum(10 ** step(state, w)[0] for w in range(width)) + 10 ** (lp + m.log_unigram(0)), 1, abs_tol=1e-6), state
    h, _ = op9_lm.hashed([t.encode() for t in [*texts, "", "f d", "c"]])
    ids, state, want = hot.ids(h), 0, []
    for w in ids.tolist():
        added, state = step(state, w)
        want.append(added)
    assert np.allclose(hot.traverse(ids), want, atol=1e-12)


@pytest.mark.parametrize(("share", "order"), [(1e-7, 3), (0.02, 3), (0.5, 3), (0.02, 2), (0.02, 4)])
def test_scores_hold_every_ngram_seen_twice(spark, monkeypatch, share, order):
    """The score is the same whatever part of the model is hot, and equals plain backoff over all n-grams seen twice; rows may repeat."""
    monkeypatch.setattr(op9_lm, "HOT_SHARE", share)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a b", "a c", "b a c", "c", "d e f", str(rng.randint(0, 60))]) for _ in range(rng.randint(0, 40))) for _ in range(40)]
    parts = [[w.encode() for w in t.split()] + [op9_lm.END] for t in texts]
    grams = [Counter(tuple(p[i : i + k]) for p in parts[:30] for i in range(len(p) - k + 1)) for k in range(1, order + 1)]
    p = plain_backoff(grams)
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = op9_lm.train(df.where("doc_id < 30"), order=order)
    assert (m.cold.where("c is null").count() > 5) == (share > 1e-6)
    got = op9_lm.score(df.union(df.where("doc_id = 3")).union(df.where("doc_id = 4").selectExpr("null", "text")), m, op9_lm.F.col("doc_id") >= 30).collect()
    assert len(got) == 42
    for r in got:
        t = parts[4 if r.doc_id is None else r.doc_id]
        assert math.isclose(r.score, sum(math.log10(p(tuple(t[max(0, j - order + 1) : j + 1]))) for j in range(len(t))), abs_tol=1e-8), r
        assert r.n_tokens == len(t) and r.n_known == sum(grams[0][(w,)] > 0 for w in t)


def plain_backoff(grams):
    """Probability of a tuple's last word after the others: absolute discounting over all n-grams seen twice. ``grams``: counts by length."""
    total, distinct = sum(grams[0].values()), len(grams[0])
    arcs, after = {g: n for c in grams[1:] for g, n in c.items() if n >= 2}, {}
    for g in arcs:
        after.setdefault(g[:-1], []).append(g)
    weights = {}

    def p(g):
        if len(g) == 1:
            return (grams[0][g] + 1) / (total + distinct + 1)
        if g in arcs:
            return (arcs[g] - 0.5) / grams[len(g) - 2][g[:-1]]
        context = g[:-1]
        if context not in weights:
            out = after.get(context, [])
            weights[context] = (1 - sum(map(p, out))) / (1 - sum(p(x[1:]) for x in out)) if out else 1
        return p(g[1:]) * weights[context]

    return p


# op10
def target_of(spark, sizes):
    base = spark.createDataFrame([("n" if s is None else f"s{s}", n) for s, n in sizes.items()], "skey string, size long")
    rows = op10_mixing.targets(op10_mixing._sources(base, op10_mixing.WEIGHTS)).collect()
    return {None if r.skey == "n" else r.skey[1:]: r.target for r in rows}


def test_targets_are_shared_again(spark):
    sizes = {"b": 100, "a": 10, None: 1000, "c": 0}
    t = target_of(spark, sizes)
    assert t["a"] == 20 and t["b"] == 200 and t["c"] == 0 and math.isclose(sum(t.values()), 1.5 * 1110)
    t = target_of(spark, {"a": 1000, "b": 1000, "c": 1000})
    assert math.isclose(t["a"], 2000) and math.isclose(t["b"], 2500 * 2 / 3) and math.isclose(t["c"], 2500 / 3)
    assert target_of(spark, {}) == {}


def test_weights_follow_the_order_of_sources(spark):
    names = sorted({f"s{random.Random(i).randrange(10**6)}" for i in range(500)})
    base = spark.createDataFrame([(f"s{n}", 1) for n in names] + [("n", 1)], "skey string, size long")
    weight = {r.skey: r.weight for r in op10_mixing._sources(base, (5, 2, 1)).collect()}
    assert weight == {**{f"s{n}": (5, 2, 1)[i % 3] for i, n in enumerate(names)}, "n": (5, 2, 1)[len(names) % 3]}


@pytest.mark.parametrize("most_bytes", [4 << 20, 0])
def test_mix_equals_sql(spark, monkeypatch, most_bytes):
    """Few sources by broadcast, many by salted joins; a hot source, null sources, ids and texts, repeated rows, sources without words."""
    import duckdb
    import pandas as pd

    r = random.Random(3)
    rows = [(i, "w " * r.randrange(1, 40), "hot" if i % 3 else f"s{i % 7}") for i in range(400)]
    rows += [(None, "no id", "s1"), (None, None, None), (7, None, "s2"), (8, "again, again", None), (8, "again, again", None), (9, "", "empty"), (10, "x\x1fy\u00a0z \x0b v", "é")]
    monkeypatch.setattr(op10_mixing, "BROADCAST_BYTES", most_bytes)
    got = op10_mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # read by name
    with duckdb.connect() as con:
        con.register("documents", documents)
        want = con.sql(op10_mixing.SQL["op10_mixing"]).fetchall()
    assert Counter(map(tuple, got)) == Counter(want) and len(want) == len(rows)
