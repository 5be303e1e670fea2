"""The text operators against brute force, round trips and odd inputs."""

import hashlib
import itertools
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import fingerprints, mixing, near_duplicates, packing, quality, queries, sharding, substrings, vectors, warc, webtext

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "one", "Two words", "two WORDS", "x " * 60, "x " * 60, "é" * 500, "a b c", "<|endoftext|> hi  there \n you"]


def documents(spark, texts, source="s"):
    rows = [(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def sets(text, n=2):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in (text or "").encode().decode().replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def components(texts, n=2):
    s, root = [sets(t, n) for t in texts], list(range(len(texts)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(texts)), 2):
        if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [len(x) for x in s], [find(i) for i in range(len(texts))]


def near_texts():
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 900, n)] for n in (5, 12, 40, 150, 400)]
    out = list(ODD)
    for words in base:
        for k in range(12):
            copy = list(words)
            for _ in range(k * len(words) // 60):
                copy[rng.integers(len(copy))] = f"e{rng.integers(10**6)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    texts = near_texts()
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(documents(spark, texts), words=words).collect()}
    sizes, comp = components(texts, words)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


@pytest.mark.parametrize("block", [3, 512])
def test_crowded_stars_lose_no_link(spark, monkeypatch, block):
    """Texts of one template share most buckets; links between others than a star's centre, and between blocks of a
    star, must be found."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rng = np.random.default_rng(9)
    shared = [f"t{x}" for x in range(120)]
    texts = []
    for k in range(14):
        own = [f"o{k}x{x}" for x in range(60)]
        for _ in range(3):
            copy = shared + own
            for i in rng.integers(0, len(copy), 4 if k % 2 else 9):
                copy[i] = f"e{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(documents(spark, texts), words=2).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts, 2)[1]


def thue_morse(n, a="a", b="b"):
    return [(a, b)[bin(i).count("1") & 1] for i in range(n)]


def test_words_in_a_regular_order_stay_apart(spark):
    """Hashes that add letters or words times powers collide on these by construction."""
    one, two = "".join(thue_morse(1024)), "".join(thue_morse(1024, "b", "a"))
    texts = [one, two, *(" ".join(["same"] * 49 + [x]) for x in (one, two)), *(" ".join(thue_morse(1024, *x)) for x in (("u", "v"), ("v", "u")))]
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(documents(spark, texts[:4]), words=2).collect()}
    assert [got[i]["component_id"] for i in range(4)] == components(texts[:4], 2)[1] == [0, 1, 2, 3]
    cut = {r["doc_id"]: r for r in substrings.remove_repeats(documents(spark, texts)).collect()}
    assert [cut[i]["n_removed"] for i in range(4)] == [0, 0, 0, 0]
    words = [t.split() for t in texts]
    gone, first = set(), {tuple(words[4][k : k + 50]) for k in range(975)}
    for k in range(975):
        if tuple(words[5][k : k + 50]) in first:
            gone |= set(range(k, k + 50))
    assert cut[5]["n_removed"] == len(gone)


def test_signatures_fill_every_bin():
    sig = near_duplicates.signatures(np.array([0, 2]), np.array([5, 1 << 63], np.uint64), 3)
    assert (sig[0] == 5).all() and (sig[2] == 1 << 63).all() and (sig[1] == np.iinfo(np.uint64).max).all()


def test_repeats(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared, texts = word(80), list(ODD)
    for k in range(8):
        texts.append(" ".join(word(30 + k) + shared[k : 52 + k * 4] + word(k)))
    texts += [" ".join(shared), " ".join(shared), " ".join(shared[:49]), " ".join(shared[10:60])]
    for k in range(5):  # runs of few words, which make each place a smallest window
        texts.append(" ".join(word(k) + ["is", "so", "it"][: 2 + k % 2] * (40 + 7 * k) + word(3) + ["a"] * (60 + k) + word(20) + ["is", "so"] * (24 + k)))
    first = {}
    words = [(t or "").encode().split() for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got = {r["doc_id"]: r for r in substrings.remove_repeats(documents(spark, texts)).collect()}
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"].encode()) == (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone))


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    model = Tokenizer.from_file(path)
    texts = [*ODD, "long text here " * 900, "it's 12 o'clock\n\n  yes \n \n no\t\tx", "two at the end  ", "line and space\n ", "one ", "  ", " \n", "tab\t ", "w " * 300_000, *(r["text"] for r in table(spark, "documents").limit(60).collect())]
    rows = packing.pack(documents(spark, texts), path).collect()
    for i, t in enumerate(texts):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert len(mine) == -(-len(ids) // 1024) and sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == 1024 for r in mine[1:])
        assert [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine] == [r["ids_crc32"] for r in mine]
    packs = {}
    for r in rows:
        packs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in packs.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024


def test_plan_uses_every_document_near_the_bound():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.clip(rng.gamma(2, 150, 20000).astype(int) + 1, 1, 1024), minlength=1025)
    used, n = np.zeros(1025, int), 0
    for shape, times in packing.plan(counts):
        assert sum(shape) <= 1024
        n += times
        for v in shape:
            used[v] += times
    assert (used == counts).all()
    assert n <= 1.01 * -(-(counts * np.arange(1025)).sum() // 1024)


def test_mix(spark):
    docs = documents(spark, ODD, None).unionByName(table(spark, "documents").select(*(c.split()[0] for c in DOCS.split(", "))).withColumn("doc_id", F.col("doc_id") + 1000))
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    size = {s: sum(r["size"] for r in by[s]) for s in names}
    left, open_, target = sum(size.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= 3 * size[s]
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    for s in names:
        assert by[s][0]["target"] == pytest.approx(target[s]) and by[s][0]["source_size"] == size[s]
        assert sum(r["taken"] for r in by[s]) == int(by[s][0]["target"])
    words = mixing.mixed_rows(docs).select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == sum(r["taken"] for r in rows)


def test_fingerprints(spark):
    texts = [*ODD, "Ａ  b", "a b ", "a b", "last"]
    rows = {r["doc_id"]: r for r in fingerprints.document_fingerprints(documents(spark, texts)).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        half = len(t) // 2
        edited = t[: len(t) - half] + plain[(i + 1) % len(plain)][:half]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        canon = lambda x: " ".join(unicodedata.normalize("NFKC", x).upper().lower().split())
        assert (rows[i]["near_edited"], rows[i]["near_next"]) == (float(canon(t) == canon(edited)), float(canon(t) == canon(plain[(i + 1) % len(plain)])))
        same = [j for j in rows if rows[j]["fingerprint"] == rows[i]["fingerprint"]]
        assert rows[i]["group_id"] == min(same) and rows[i]["copies"] == len(same)
        assert all(rows[j]["fingerprint"] == rows[i]["fingerprint"] for j in range(len(plain)) if plain[j] == t)
    assert rows[11]["fingerprint"] == rows[12]["fingerprint"] == rows[13]["fingerprint"] != rows[14]["fingerprint"]
    assert rows[11]["near_next"] == 1.0 and rows[13]["near_next"] == 0.0


@pytest.mark.parametrize(("most", "block"), [(4096, 4096), (16, 4096), (16, 7)])
def test_vectors(spark, monkeypatch, most, block):
    """In one and in two levels of pivots, and with lists in blocks; repeated and null ids, extra columns, no rows."""
    monkeypatch.setattr(vectors, "MOST_PIVOTS", most)
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CROWD", 10 * block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    many = [list(map(float, b + s * rng.normal(size=16))) for b in base for s in (0, 0.05, 0.1, 0.2, 0.3, 0.4)]
    many += [many[0], many[0], None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0]]
    rows = vectors.near_vectors(spark.createDataFrame(list(enumerate(many)), "vec_id long, embedding array<double>")).collect()
    good = [i for i, v in enumerate(many) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    m = np.array([many[i] for i in good])
    m /= np.linalg.norm(m, axis=1)[:, None]
    links = (m @ m.T >= 0.9).sum(1) - 1
    want, got = dict(zip(good, links, strict=True)), {r["vec_id"]: r["n_links"] for r in rows}
    assert all(got[i] <= want.get(i, 0) for i in range(len(many)))
    assert sum(got.values()) >= 0.9 * links.sum()
    assert all(got[i] == 0 for i in range(len(many)) if i not in want)
    names = ("rep", "v", "copies", "pivots", "pivot", "block", "cell", "c", "n")
    odd = spark.createDataFrame([(None, many[0]), (1, many[0]), (1, many[0]), (1, many[7]), (3, None)], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in names})
    rows = vectors.near_vectors(odd).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, 0, True), (1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True), (3, 0, 3, True)]
    assert vectors.near_vectors(odd.limit(0)).count() == 0


def test_vectors_of_any_number(spark, monkeypatch):
    """No limit on pivots changes what is found, and links don't get lost as a table grows: one way for all sizes."""
    monkeypatch.setattr(vectors, "PER_PIVOT", 4)
    rng = np.random.default_rng(5)
    groups = rng.normal(size=(1500, 1, 64)) + 0.27 * rng.normal(size=(1500, 4, 64))
    m = groups.reshape(-1, 64).astype(np.float32).astype(float)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    assert want.sum() > 15000
    table = spark.createDataFrame(list(enumerate(m.tolist())), "vec_id long, embedding array<float>").cache()
    found = []
    for most in (1024, 4096):
        monkeypatch.setattr(vectors, "MOST_PIVOTS", most)
        found.append(sorted(tuple(r) for r in vectors.near_vectors(table).collect()))
    assert found[0] == found[1]
    got = np.array([n for _, n, _, _ in found[0]])
    assert (got <= want).all() and got.sum() >= 0.998 * want.sum()


PAGE = """<html><head><title>t</title></head><body><header>Top</header><nav><a>x</a></nav><div class="cookie-notice">ok</div>
<article><h1>T &amp; U</h1><p>one <b>two</b>
 three<p>four<br>five<form>no</form><div id="comments">reader</div></article><aside>s</aside><footer>f</footer></body></html>"""


def test_page_text(spark):
    plain = [f"<html><body><div>Site name</div><div><p>Body {i} words</p></div></body></html>" for i in range(4)]
    pages = [(0, "http://a.x/1", PAGE), (1, None, None), (2, "http://b.x", ""), *((10 + i, f"http://c.x/{i}", h) for i, h in enumerate(plain))]
    rows = {r["page_id"]: r for r in webtext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert rows[0]["text"] == "T & U\none two three\nfour five" and rows[0]["n_chars"] == len(rows[0]["text"])
    assert rows[1]["text"] == rows[2]["text"] == ""
    assert [rows[10 + i]["text"] for i in range(4)] == [f"Body {i} words" for i in range(4)]


def test_wrapper_decides_inside_landmarks(spark):
    pages = [(i, f"http://d.x/{i}", f"<body><article><h1>Title {i}</h1><div>Read our terms</div><p>Body {i} words</p></article></body>") for i in range(4)]
    rows = {r["page_id"]: r["text"] for r in webtext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert rows == {i: f"Title {i}\nBody {i} words" for i in range(4)}


def test_constants_of_all_shapes_and_groups(spark):
    """Single items where others repeat them, constant items of lists, and shapes that are seen once."""
    items = ["", "<li>Topic 1</li>", "<li>Topic 2</li>", "<li>Topic 3</li>", ""]
    pages = [(i, f"http://e.x/{i}", f"<body><div>Site name</div><ul><li>Home</li>{t}</ul><p>Body {i} words</p></body>") for i, t in enumerate(items)]
    extra = ["", "<h2>Two {0}</h2>", "<h3>Three {0}</h3>", "<hr><h4>Four {0}</h4>"]
    pages += [(10 + i, f"http://f.x/{i}", f"<body><div>Site name</div>{x.format(i)}<p>Body {i} words</p></body>") for i, x in enumerate(extra)]
    pages += [(20 + i, f"http://g.x/{i}", "<body><div>Same</div><p>copy</p></body>") for i in range(4)]
    rows = {r["page_id"]: r["text"] for r in webtext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [rows[i] for i in range(5)] == ["Body 0 words", *(f"Topic {i}\nBody {i} words" for i in (1, 2, 3)), "Body 4 words"]
    assert [rows[10 + i] for i in range(4)] == ["Body 0 words", *(f"{w} {i}\nBody {i} words" for i, w in ((1, "Two"), (2, "Three"), (3, "Four")))]
    assert [rows[20 + i] for i in range(4)] == ["Same\ncopy"] * 4


def test_wrapper_has_optional_and_repeated_groups():
    seq = lambda h: webtext.fold(webtext.walk(webtext.stream(h))[0])[0]
    wrapper = [[x, False] for x in seq("<ul><li>a</li><li>b</li></ul><p>x</p>")]
    wrapper = webtext.align(wrapper, [[x, False] for x in seq("<ul><li>a</li></ul><b>n</b><p>x</p>")])
    assert [n for n, o in wrapper if isinstance(n, tuple)] == [("+", "<li >", "#li", "</li>")]
    assert [n for n, o in wrapper if o] == ["<b >", "#b", "</b>"]


def test_article_text_that_labels_once_lost(spark):
    """Class names with other words in them, an article's own header, several articles, teasers and menus without names."""
    body = [f"words of paragraph {i} that is long enough to count " * 3 for i in range(5)]
    pages = [
        (0, "http://h.x/0", f'<main><h1>T</h1><p>{body[0]}</p><section class="related-work"><p>Earlier work</p></section></main>'),
        (1, "http://h.x/1", f'<article><div class="article-header"><h1>Own title</h1></div><p>{body[1]}</p></article>'),
        (2, "http://h.x/2", f"<article><header><h1>Kept</h1></header><p>{body[2]}</p></article>"),
        (3, "http://h.x/3", f"<article><p>First {body[3]}</p></article><article><p>Second {body[3]}</p></article><article>tease</article>"),
        (4, "http://h.x/4", f'<div><a href="1">one</a><a href="2">two</a><a href="3">three</a></div><p>{body[4]}</p><div class="user-comments"><p>me too</p></div>'),
    ]
    rows = {r["page_id"]: r["text"] for r in webtext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    body = [x.strip() for x in body]
    assert rows == {0: f"T\n{body[0]}\nEarlier work", 1: f"Own title\n{body[1]}", 2: f"Kept\n{body[2]}", 3: f"First {body[3]}\nSecond {body[3]}", 4: body[4]}


@pytest.mark.parametrize("fan", [2, 32])
def test_generated_site_against_its_template(spark, monkeypatch, fan):
    """Pages of a generated site, with optional parts and repeated groups in the template, give back what was put in,
    however the streams are dealt; texts, hosts and rows that repeat make no difference."""
    monkeypatch.setattr(webtext, "wrappers", (lambda f: lambda pages: f(pages, fan))(webtext.wrappers))
    rng, pages, want = np.random.default_rng(8), [], {}
    for i in range(80):
        host = "hot" if i % 2 else f"h{i % 3}"
        paras = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, rng.integers(3, 30))) for _ in range(rng.integers(1, 6))]
        extra = "<section><h2>In brief</h2></section>" if rng.random() < 0.5 else ""
        units = "".join(f"<li><i>{rng.integers(10**6)}</i> <b>item</b></li>" for _ in range(rng.integers(2, 5)))
        html = f"<body><div>Site of {host}</div><div>All rights</div>{extra}<h1>Title {i}</h1>" + "".join(f"<p>{p}</p>" for p in paras) + f"<ul>{units}</ul><div>Made with care</div></body>"
        pages.append((i, f"http://{host}.x/{i}", html))
        want[i] = [f"Title {i}", *paras]
    pages += [(100, None, None), (101, "http://hot.x/empty", ""), (102, "http://hot.x/long", "<p>" + "long " * 400_000), (None, "http://q.x", "<p>no id")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "shape", "part", "slot", "text")})
    rows = {r["page_id"]: r["text"] for r in webtext.extract(frame).collect()}
    for i, lines in want.items():
        assert [x for x in rows[i].split("\n") if "item" not in x and x.split(" ")[0].strip("0123456789")] == lines
    assert rows[100] == rows[101] == "" and len(rows[102]) == 5 * 400_000 - 1 and rows[None] == "no id"
    assert webtext.extract(frame.limit(0)).count() == 0


def test_archive(spark):
    big = "<p>" + "y" * 1200
    pages = [(0, "http://a.b.c/x?q", big), (1, "http://a.b.c/x?q", big), (2, None, None), (3, "", "small"), (4, "http://z", "small"), (5, "http://q/é", big), (6, "nonsense://[", "é" * 600)]
    rows = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in rows.items()} == {0: ("revisit", 5), 1: ("revisit", 5), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert all((r["payload_bytes"], r["payload_digest"]) == (len((pages[i][2] or "").encode()), hashlib.sha1((pages[i][2] or "").encode()).hexdigest()) for i, r in rows.items())
    assert warc.url_key("http://A.b.C:80/p?q") == "c,b,a)/p?q"


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs.unionByName(documents(spark, ODD).withColumn("doc_id", F.col("doc_id") + 10**6)), labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    assert quality.classify(documents(spark, ODD), labels.limit(0)).count() == len(ODD)


def test_quality_against_plain_numpy(spark):
    """Cosines, ridge scores of two folds and pooled violators, computed anew from the statistics."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    rows = quality.features(docs).join(labels, "doc_id", "left").select("doc_id", "x", "quality", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("fold")).collect()
    known = [r for r in rows if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    x, y, fold = np.array([r["x"] for r in known]), np.array([float(r["quality"]) for r in known]), np.array([r["fold"] for r in known])
    mean, scale, rng = x.mean(0), np.maximum(x.std(0), 1e-6), np.random.default_rng(7)
    turn, shift = rng.normal(size=(x.shape[1], 384)) / np.sqrt(2 * x.shape[1]), rng.uniform(0, 2 * np.pi, 384)
    wave = lambda v: np.hstack([np.cos((v - mean) / scale @ turn + shift) * np.sqrt(2 / 384), np.ones((len(v), 1))])
    z = wave(x)
    ridge = lambda keep, n: np.linalg.solve(z[keep].T @ z[keep] + 1e-3 * np.sqrt(n) * np.eye(385), z[keep].T @ y[keep])
    whole, folds = ridge(fold >= 0, len(y)), [ridge(fold == k, len(y) / 2) for k in (0, 1)]
    raw = np.where(fold == 0, z @ folds[1], z @ folds[0])
    place = np.clip(np.floor((raw + 0.5) * 250), 0, 499).astype(int)
    pools = [[raw[place == b].mean(), y[place == b].mean(), (place == b).sum()] for b in np.unique(place)]
    k = 0
    while k + 1 < len(pools):
        a, b = pools[k], pools[k + 1]
        if a[1] >= b[1]:
            pools[k : k + 2] = [[(a[j] * a[2] + b[j] * b[2]) / (a[2] + b[2]) for j in (0, 1)] + [a[2] + b[2]]]
            k = max(k - 1, 0)
        else:
            k += 1
    want = np.clip(np.interp(wave(np.array([r["x"] for r in rows])) @ whole, [p[0] for p in pools], [p[1] for p in pools]), 0, 1)
    assert np.abs(want - [got[r["doc_id"]] for r in rows]).max() < 1e-5


def test_odd_rows_and_empty_tables_of_quality_and_archives(spark):
    labels = table(spark, "labels")
    odd = spark.createDataFrame([(None, "null id"), (1, "a b c"), (1, "a b c"), (1, "other text"), (2, None)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("x", "y", "fold", "score", "bin")})
    assert quality.classify(odd, labels).count() == 5 and quality.classify(odd.limit(0), labels).count() == 0
    assert quality.accepted(odd, labels.limit(0)).count() == 0
    page = "<p>" + "long " * 400_000
    pages = spark.createDataFrame([(1, "http://a.b/x", page), (1, "http://a.b/x", page), (2, None, None), (None, "http://a.b/x", page), (3, "http://a.b/y", "")], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "size", "kind", "head", "n", "tie", "archive", "at", "length")})
    rows = warc.round_trip(pages).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in rows) == [(0, "revisit", 1, len(page)), (1, "response", 0, len(page)), (1, "response", 0, len(page)), (2, "response", 0, 0), (3, "response", 0, 0)]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    docs, names = table(spark, "documents"), [f"s{i}" for i in range(5)]
    back = sharding.write_shards(docs, "doc_id", names, str(tmp_path / "shards"), 101)
    empty = sharding.write_shards(docs.limit(0).withColumn("shard", F.lit("x")), "doc_id", names, str(tmp_path / "empty"), 101)
    assert empty.count() == 0 and empty.schema["shard"].dataType == back.schema["shard"].dataType
    want = {(r["doc_id"], r["shard"]) for r in sharding.place(docs, "doc_id", names, 101).collect()}
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == want and back.count() == docs.count()
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in docs.collect())


def test_sharding(spark):
    names = [f"s{i}" for i in range(7)]
    table_ = sharding.fill(names, 1009)
    counts = np.bincount(table_)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.fill(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table_, fewer, strict=True)) < 0.5 * 1009
    keys = spark.createDataFrame([(None, 0), ("a", 1), ("a", 2), ("", 3)], "key string, slot int")
    rows = sharding.place(keys, "key", names, 1009).collect()
    assert len(rows) == 4 and len({r["shard"] for r in rows if r["key"] == "a"}) == 1
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


@pytest.mark.parametrize("call", [
    lambda d: near_duplicates.near_duplicates(d), lambda d: substrings.remove_repeats(d), lambda d: packing.pack(d, queries.tokenizer_path()), lambda d: mixing.mix(d),
    lambda d: fingerprints.document_fingerprints(d), lambda d: sharding.place(d, "doc_id", ["a", "b"], 11),
])
def test_empty_null_and_extra(spark, call):
    docs = documents(spark, [])
    assert call(docs).count() == 0
    odd = spark.createDataFrame([(None, "null id", None, None, None), (1, "a b c", None, None, None), (1, "a b c", None, None, None), (1, "other text", None, None, None)], DOCS)
    odd = odd.withColumns({c: F.lit(1) for c in ("id", "key", "length", "size", "rank", "t", "n", "component_id", "whole")})
    assert call(odd).count() >= 4


def test_pipeline(spark):
    docs, n = table(spark, "documents"), []
    names = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        if i < 4:
            assert docs.columns == names
            docs = corpus_pipeline.materialize(docs, "test-stage")
            n.append(docs.count())
    assert 0.7 * 200 < n[0] < 200 and n[1] <= n[0] and n[2] <= n[1]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_mix_cuts_no_text(spark):
    docs = table(spark, "documents")
    known = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert {(r["doc_id"], r["text"]) for r in corpus_pipeline.weighted_mix(spark, docs, SMALL).collect()} <= known


def plain_corpus(docs):
    """Stages 2 to 4 in plain Python: [doc_id, text] of the mix of ``docs`` (doc_id, text, source), which are in order."""
    comp = components([t for _, t, _ in docs], 2)[1]
    docs = [d for i, d in enumerate(docs) if comp[i] == i]
    words, first, kept = [d[1].encode().split() for d in docs], {}, []
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, (w, (doc, text, source)) in enumerate(zip(words, docs, strict=True)):
        gone = {x for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for x in range(k, k + 50)}
        if not w or len(gone) < len(w):
            kept.append((doc, b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else text, source))
    size = {s: sum(len(t.encode().split()) for _, t, x in kept if x == s) for s in sorted({d[2] for d in kept})}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(size)}
    left, open_, target = sum(size.values()), set(size), {}
    while over := {s for s in open_ if weight[s] * left / sum(weight[x] for x in open_) > 3 * size[s]}:
        target |= {s: 3 * size[s] for s in over}
        left, open_ = left - sum(3 * size[s] for s in over), open_ - over
    target |= {s: weight[s] * (left / sum(weight[x] for x in open_)) for s in open_}
    out = []
    for s in size:
        whole = int(target[s] / size[s])
        quota = int(target[s]) - whole * size[s]
        for doc, text, _ in sorted((d for d in kept if d[2] == s), key=lambda d: hashlib.md5(f"mix:{d[0]}".encode()).hexdigest()):
            n = len(text.encode().split())
            out += [(doc, text)] * (n and whole + (quota > 0))
            quota -= n
    return out


def test_pipeline_run_against_plain_python(spark):
    from tokenizers import Tokenizer

    model, docs = Tokenizer.from_file(queries.tokenizer_path()), table(spark, "documents")
    good = corpus_pipeline.good_documents(spark, docs, SMALL).select("doc_id", "text", "source").orderBy("doc_id").collect()
    want = Counter()
    for doc, text in plain_corpus([tuple(r) for r in good]):
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or 1024
        cuts = [(0, head), *((k, 1024) for k in range(head, len(ids), 1024))]
        want.update((doc, start, length, zlib.crc32(ids[start : start + length].tobytes())) for start, length in cuts)
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    packs = {}
    for r in rows:
        packs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in map(sorted, packs.values()):
        assert [o for o, _ in p] == [0, *itertools.accumulate(n for _, n in p[:-1])] and sum(n for _, n in p) <= 1024


def odd_documents(spark):
    """Null ids, texts and sources, repeated ids with other texts, equal rows, and extra columns with clashing names."""
    good = [r["text"] for r in table(spark, "documents").orderBy("doc_id").limit(60).collect()]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(good)]
    rows += [(None, good[0] + " and more words", "en", None, 1), (None, "other words without an id", "en", "b", 1), (None, None, None, None, None), (7, "another text of the same id", "en", "a", 1), (8, good[8], "en", "a", len(good[8])), (900, None, "en", "a", None), (901, "", "en", "a", 0), (902, " \t ", "en", "a", 3), (903, "w " * 400_000, "en", "c", 800_000)]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.withColumns({c: F.lit(k) for k, c in enumerate(("id", "t", "turn", "turns", "words", "row", "cut", "part", "whole", "size", "s0", "other", "k0", "rep", "h", "places"))})


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_odd_rows(spark, k):
    docs = odd_documents(spark)
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, SMALL)
    assert out.columns == docs.columns and stage(spark, docs.limit(0), SMALL).count() == 0
    rows, got = [(r["doc_id"], r["text"]) for r in docs.collect()], Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert set(got) <= set(rows) or name == "substring_dedup"
    if name == "quality_classifier":
        model = {(r["doc_id"], r["predicted"]) for r in quality.classify(docs, table(spark, "labels")).collect()}
        assert all((d, 1) in model for d, _ in got)
    if name == "minhash_near_dedup":
        assert {t for d, t in got if d is None} == {t for d, t in rows if d is None} and got[(8, dict(rows)[8])] <= 1
        assert all(got[(d, t)] == 1 for d, t in rows if d in (900, 901, 902, 903) or d == 7 and (7, "another text of the same id") in got)
    if name == "substring_dedup":
        assert all(got[(d, t)] == rows.count((d, t)) for d, t in rows if d is None or d in (900, 901, 902, 903))
        assert all(any(d == x and set((t or "").split()) <= set((y or "").split()) for x, y in rows) for d, t in got)
    if name == "source_mix":
        sized = {(r["doc_id"], r["size"]): r for r in mixing.mix(docs).collect()}
        for d, t in set(rows):
            n = len((t or "").encode().split())
            r = sized[(d, n)]
            assert got[(d, t)] == rows.count((d, t)) * (r["whole"] + (r["part"] > 0)) * (n > 0)
