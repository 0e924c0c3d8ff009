import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framesift.llm import embedding_dedup as emb, jaccard_join as jac, template_extract as tpl
from framesift.llm.components import components, local_roots
from framesift.llm.packed import Packer, runs, unpack

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_components_of_odd_graphs(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(300, 300), (7, 6), (500, 400), (500, 400)]
    df = spark.createDataFrame(links, "a long, b long")
    groups = Groups({x for l in links for x in l})
    for a, b in links:
        groups.join(a, b)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {x: groups.find(x) for x in groups.up if x != 300}
    assert components(df.limit(0)).count() == 0


def test_parts_of_a_graph_are_joined_up():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, m = rng.integers(1, 60), rng.integers(1, 80)
        a, b = rng.integers(0, n, m) * 7 - 50, rng.integers(0, n, m) * 7 - 50
        groups = Groups({*a.tolist(), *b.tolist()})
        for x, y in zip(a.tolist(), b.tolist()):
            groups.join(x, y)
        node, root = local_roots(a, b)
        assert dict(zip(node.tolist(), root.tolist())) == {x: groups.find(x) for x in groups.up if groups.find(x) != x}


def test_pairs_meet_once_with_their_first_leader():
    """Members of several groups: each pair of different components comes out once, whatever the blocks."""
    rng = np.random.default_rng(3)
    leaders_of = {n: sorted(rng.choice(12, 4, replace=False).tolist()) for n in range(40)}
    component = {n: int(rng.integers(0, 25)) for n in leaders_of}
    cells = bytes(jac.LEAST_CELLS)
    for parts in (1, 3):
        rows = []
        for n, own in leaders_of.items():
            for r in own:
                for other in range(parts):
                    mine = n % parts
                    rows.append(dict(leader=r, i=min(mine, other), j=max(mine, other), second=mine >= other, node=n,
                                     component=component[n], n=50, cells=cells, leaders=own))
        got = jac._across(pa.Table.from_pylist(rows)).to_pylist()
        want = {(a, b) for a, b in itertools.combinations(leaders_of, 2)
                if component[a] != component[b] and set(leaders_of[a]) & set(leaders_of[b])}
        assert len(got) == len(want) and {tuple(sorted(p.values())) for p in got} == want


def test_packed_rows_come_back():
    kind = np.dtype([("key", "<u4"), ("node", "<i8")])
    key = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    packer = Packer(kind, 7)
    blocks = [*packer.add(key, node=np.arange(1000)), *packer.add(key[:10], node=np.arange(10)), *packer.flush()]
    table = pa.Table.from_batches(blocks)
    total = 0
    for b in set(table["bucket"].to_pylist()):
        rows = unpack(table.filter(pa.compute.equal(table["bucket"], b))["block"], kind)
        assert all(int(key[r["node"]]) & 0xFFFFFFFF == r["key"] for r in rows)
        total += len(rows)
    assert total == 1000
    assert [x.tolist() for x in runs(np.array([1, 1, 2, 5, 5, 5]))] == [[0, 2, 3], [2, 1, 3]]


# ---- Jaccard join -------------------------------------------------------------------------------------

def shingle_set(text):
    own = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(own[k:k + 5]) for k in range(len(own) - 4)) or frozenset([tuple(own)] if own else [])


def brute_links(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    groups = Groups(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a][1], sets[b][1]
        both = len(x & y)
        if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
            groups.join(a, b)
    low = {}
    for k, (i, s) in enumerate(sets):
        if s:
            low.setdefault(groups.find(k), []).append(i)
    return [(i, len(s), min((x for x in low[groups.find(k)] if x is not None), default=None) if s else i)
            for k, (i, s) in enumerate(sets)]


def near_copies(seed, n=260):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.55:
            own = list(rng.choice(texts[-40:]))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 12])):
                if own:
                    own[rng.randrange(len(own)):][:1] = []
                    own.insert(rng.randrange(len(own) + 1), word())
                    if rng.random() < 0.5:
                        own.pop(rng.randrange(len(own)))
        else:
            own = [word() for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 7, 8, 9, 12, 20, 40, 90, 200]))]
            if rng.random() < 0.3:
                own += passage
        texts.append(own)
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in own)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n "), (3, rows[3][1]), (None, "lone words here that nobody has")]


@pytest.mark.parametrize("seed, block", [(1, 2048), (2, 3)])
def test_join_equals_comparing_all(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jac, "BLOCK", block)
    rows = near_copies(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jac.links(docs).collect()]
    assert Counter(got) == Counter(brute_links(rows))


def test_join_on_the_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jac.links(docs).collect()) == Counter(brute_links(rows))


@pytest.mark.parametrize("deleted", [0, 1, 2])
def test_similar_sets_always_share_a_key(deleted):
    """The pigeonhole itself, also with shingles that are wrongly taken for common and one-deletion segments."""
    rng = np.random.default_rng(deleted)
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _ in range(250):
        n = int(rng.choice([3, 4, 5, 6, 7, 8, 10, 15, 30, 60, 150]))
        a = np.unique(rng.integers(1, 1 << 62, n, dtype=np.uint64))
        plus = int(rng.integers(0, n // 3 + 1))
        minus = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate((rng.permutation(a)[:len(a) - minus], rng.integers(1, 1 << 62, plus, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if both * 100 < 75 * (len(a) + len(b) - both):
            continue
        hot = np.sort(rng.permutation(np.union1d(a, b))[:int(rng.integers(0, n))])
        common = (hot, rng.integers(1, 99, len(hot))) if len(hot) else empty
        values, where = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
        found = [], []
        for number, band in enumerate(jac.bands(max(len(a), len(b)))):
            if band.high <= jac.SMALL:
                band = jac.exact_band(band.low, band.high, deleted)
            row, key = jac.keys(band, number, values, where, common)
            for r in (0, 1):
                found[r].extend(key[row == r].tolist())
        assert set(found[0]) & set(found[1])


def test_cells_never_rule_out_similar_sets():
    rng = np.random.default_rng(8)
    for n in (1, 5, 40, 127, 128, 700, 3000):
        a = np.unique(rng.integers(1, 1 << 62, n, dtype=np.uint64))
        for change in (0.0, 0.1, 0.14, 0.2, 0.6):
            b = np.unique(np.concatenate((a[int(n * change):], rng.integers(1, 1 << 62, int(n * change), dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            similar = both * 100 >= 75 * (len(a) + len(b) - both)
            for share in (jac.COARSE, jac.FINE):
                open_ = jac._possible([jac._cells(a, share)], [jac._cells(b, share)], np.array([len(a)]), np.array([len(b)]))[0]
                assert open_ or not similar
            assert n < 100 or change < 0.3 or not open_


def test_one_document_of_each_group_stays(spark):
    rows = near_copies(3, 120)
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _tag long")
    kept = jac.keep_one(docs)
    assert kept.schema == docs.schema
    want = Counter()
    for i, n, c in brute_links(rows):
        if not n:
            want[i] += 1
        elif c == i:
            want[i] = 1
    want[None] = 1
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jac.links(docs).count() == 0 and jac.keep_one(docs).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jac.links(blank).collect()) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]
    assert jac.keep_one(blank).count() == 3


# ---- embeddings ---------------------------------------------------------------------------------------

def near_vectors(seed, d=24, n=900):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d)).astype(np.float32)
    parts = [base]
    for scale in (0.02, 0.1, 0.3, 0.45):  # cosines from nearly 1 down to the threshold
        some = base[rng.choice(n, 120)]
        noise = rng.standard_normal(some.shape)
        some = some / np.linalg.norm(some, axis=1, keepdims=True)
        noise = noise / np.linalg.norm(noise, axis=1, keepdims=True)
        parts.append((some + noise * scale).astype(np.float32))
    parts.append(base[:1] + rng.standard_normal((300, d)).astype(np.float32) * 0.05)  # one large group
    return np.concatenate(parts)


def test_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(emb, "BLOCK", 64)
    x = near_vectors(1)
    x = np.concatenate((x, np.repeat(x[5:6], 40, axis=0)))  # and one of exact copies
    df = spark.createDataFrame([(i, v.tolist(), "e") for i, v in enumerate(x)], "vec_id long, embedding array<float>, links string")
    got = sorted(emb.near_duplicates(df).collect(), key=lambda r: r.vec_id)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = unit @ unit.T >= emb.THRESHOLD
    np.fill_diagonal(link, False)
    n = np.array([r.n_links for r in got])
    assert (n <= link.sum(axis=1)).all()                  # none below the threshold, none twice
    assert n.sum() >= 0.97 * link.sum()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    label = emb._joined(link)
    assert np.mean([label[r.vec_id] == r.component_id for r in got]) > 0.97


def test_long_runs_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(emb, "PAIRED", 20)
    monkeypatch.setattr(emb, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.standard_normal(16) + rng.standard_normal((150, 16)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in emb.near_duplicates(df).collect()} == {(149, 0)}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]),
            (8, [2.0, 2.0]), (9, [1.0]), (10, [-1.0, -1.0]), (None, [0.0, 5.0]), (11, [1e-30, 1e-30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in emb.near_duplicates(df).collect()))
    assert got == [(0, 0, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
                   (6, 0, 6, True), (7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False), (9, 0, 9, True), (10, 0, 10, True),
                   (11, 3, 7, False)]
    assert emb.near_duplicates(df.limit(0)).count() == 0


def test_rotation_balances_bits():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 32)) * np.linspace(0.2, 3, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = emb.learn(x, 3000)
    bits = x @ codes.rotations > 0
    assert abs(bits.mean(axis=0) - 0.5).max() < 0.1
    assert codes.rotations.shape[1] >= codes.width * codes.tables
    turn = codes.rotations[:, :32]
    assert np.allclose(turn.T @ turn, np.eye(32), atol=1e-8)


@pytest.mark.parametrize("d, lean", [(64, 0.0), (256, 0.0), (256, 3.0), (64, 3.0), (700, 0.0)])
def test_pairs_at_the_threshold_meet(d, lean):
    """Pairs at a cosine of just 0.9, also in long vectors and where all vectors lean to one side with shrinking axes."""
    rng = np.random.default_rng(d)
    scale = np.linspace(1, 0.1, d)
    x = rng.standard_normal((3000, d)) * scale + lean * scale.mean() * rng.standard_normal(d)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(x.shape) * scale
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * side
    codes = emb.learn(np.concatenate((x, y))[:3000], 50_000)
    a, b = codes.of(x), codes.of(y)
    near = np.bitwise_count(a ^ b)
    met = (near <= 1).any(axis=1) & (near.sum(axis=1) <= codes.radius)
    assert met.mean() >= 0.93


def test_a_run_of_many_blocks(spark, monkeypatch):
    """Members are handed on once; pairs of blocks are dealt out by Spark."""
    monkeypatch.setattr(emb, "BLOCK", 16)
    rng = np.random.default_rng(9)
    x = rng.standard_normal(32) + rng.standard_normal((300, 32)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in emb.near_duplicates(df).collect()} == {(299, 0)}


# ---- pages --------------------------------------------------------------------------------------------

def page(k, body, nav="Home", extra=""):
    return (f"<!DOCTYPE html><html><head><title>t{k}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            f"<nav><ul><li><a href=/x>{nav}</a></li></ul></nav><!-- note {k} --><div class=\"ad\">Buy {k}!</div>{extra}"
            f"{body}<footer>&copy; site</footer></body></html>")


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"),
    (page(1, "<article><h1>T &lt;1&gt;</h1><p><b>One\n two.<br>three<p>four</p></article>"), "T <1>\n\nOne two. three\n\nfour"),
    (page(2, "<div><p>No article</p></div>"), "No article"),
    (page(3, "<article><header><h1>Title</h1></header><p>x</p><div class='comments'><p>first!</p></div></article>"), "Title\n\nx"),
    (page(4, "<main><p>a</p><aside>side</aside><form>f<input></form><p>b<i>c</i>d</p></main>"), "a\n\nbcd"),
    (page(5, "<header>top</header><div id=cookie-notice>we use</div><p>y &copy z</p>"), "y © z"),
    (page(6, "<article><p>tail is <b>open"), "tail is open© site"[:12]),
    ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1\n\n2\n\n3\n\n4"),
    ("<p>5 < 6 and 7 > 2</p><textarea><p>no</p></textarea><p hidden>no</p>", "5 < 6 and 7 > 2"),
    ("<article>a&nbsp;&nbsp;b</article><script>x", "a b"), ("<p title='a>b'>q</p>", "q"), ("<p", ""),
])
def test_main_text(html, text):
    assert tpl.extract(html or "", []) == text


@pytest.mark.parametrize("html", [
    '<html class="no-sidebar"><body class="menu"><div class="layout with-sidebar">{}</div></body></html>',
    '<div style="overflow:hidden">{}</div>', '<div class="overflow-hidden">{}</div>', '<div aria-hidden="false">{}</div>',
    '<section class="category-social" data-role="search">{}</section>', '<div title="class=ad hidden">{}</div>'])
def test_wrappers_are_no_furniture(html):
    for body in ("<p>own</p>", "<article class='social'><p>own</p></article>"):
        assert tpl.extract(html.format(body), []) == "own"


def test_what_holds_the_article_is_no_furniture():
    assert tpl.extract("<div class='widget'><div class=menu>m</div><main><p>own</p></main></div>", []) == "own"
    assert tpl.extract("<div class='notice'><article><p>own</p></article></div>"
                       "<div class=comments><article><p>first!</p></article></div>", []) == "own"
    assert tpl.extract("<aside><article><p>teaser</p></article></aside><p>own</p>", []) == "own"
    assert tpl.extract("<p>own</p><p HIDDEN>a</p><p style='color:red; display : none'>b</p><p aria-hidden=true>c</p>"
                       "<div class='site-footer'>d</div><div class='x sidebar'>e</div><div id=main_nav>f</div>", []) == "own"


def test_static_texts_of_a_host_are_template(spark):
    notice = "<div class=x1>Thank you for reading our pages</div>"
    rows = [(k, f"https://a.example/{k}", page(k, f"<div><p>own text {k} is here</p>{notice}</div>")) for k in range(40)]
    rows += [(100 + k, f"https://b.example/{k}", page(k, f"<div>{notice}<p>few pages {k}</p></div>")) for k in range(3)]
    rows += [(200, None, None), (201, "no url", "<p>z</p>"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in tpl.main_text(df).collect()}
    assert tpl.main_text(df).count() == len(rows)
    assert got[7].text == "own text 7 is here" and got[7].n_chars == len(got[7].text)
    assert got[101].text == "Thank you for reading our pages\n\nfew pages 1"   # too few pages to tell
    assert got[200].text == "" and got[201].text == "z"
    assert tpl.main_text(df.limit(0)).count() == 0


def test_small_hosts_have_templates_and_copies_are_no_template(spark):
    notice = "<div class=x1>Thank you for reading our pages</div>"
    long = " ".join(f"word{i}" for i in range(30))
    copy = page(1, f"<div><p>own words of one page</p><p>{long}</p></div>")
    rows = [(k, f"https://small.example/{k}", page(k, f"<div><p>own text {k} is here</p>{notice}</div>")) for k in range(5)]
    rows += [(100 + k, f"https://copies.example/{k}", copy) for k in range(30)]
    rows += [(130 + k, f"https://copies.example/other{k}", page(k, f"<div><p>quite another{k}</p></div>")) for k in range(2)]
    rows += [(200 + k, f"https://long.example/{k}", page(k, f"<div><p>{long}</p><p>own{k} one{k}</p>{notice}</div>")) for k in range(30)]
    rows += [(300 + k, f"https://one.example/{k}", page(k, "<article><p>the same few words</p></article>")) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in tpl.main_text(df).collect()}
    assert all(got[k] == f"own text {k} is here" for k in range(5))
    assert all(got[100 + k] == f"own words of one page\n\n{long}" for k in range(30))
    assert all(got[200 + k] == f"{long}\n\nown{k} one{k}" for k in range(30))
    assert all(got[300 + k] == "the same few words" for k in range(30))


def follow_us(n, host, body="<p>own words of page {k}, none like them</p>"):
    line = "<p>Follow us on our channels today</p>"
    return [(1000 + k, f"https://{host}/{k}", page(k, f"<article><h1>Title {k}</h1>{body.format(k=k)}{line}</article>")) for k in range(n)]


def test_the_template_decides_inside_an_article(spark, monkeypatch):
    df = spark.createDataFrame(follow_us(12, "c.example"), "page_id long, url string, html string")
    got = {r.page_id: r.text for r in tpl.main_text(df).collect()}
    assert got == {1000 + k: f"Title {k}\n\nown words of page {k}, none like them" for k in range(12)}
    # Versions of one text: what they share is not taken for template.
    shared = "".join(f"<p>paragraph {i} of the text that all versions have</p>" for i in range(9))
    df = spark.createDataFrame(follow_us(12, "d.example", shared + "<p>version {k}</p>"), "page_id long, url string, html string")
    assert all("paragraph 8 of the text" in r.text and "channels" in r.text for r in tpl.main_text(df).collect())


def test_classes_by_whole_vectors(spark):
    """Brute force: occurrence vectors written out, equal ones grouped."""
    df = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.host, r.html, r.key) for r in df.select(
        tpl.host_of("url").alias("host"), "html", F.xxhash64("html").alias("key")).dropDuplicates(["host", "key"]).collect()]
    hosts = {}
    for host, html, _ in rows:
        hosts.setdefault(host, []).append(Counter(tpl.tokens(html or "")))
    want = {}
    for host, pages in hosts.items():
        groups = {}
        for token in set().union(*pages):
            vector = tuple(p[token] for p in pages)
            support = sum(v > 0 for v in vector)
            if support >= tpl.MIN_PAGES and support * 100 >= tpl.SUPPORT * len(pages):
                groups.setdefault(vector, set()).add(token)
        large = {frozenset(g) for g in groups.values() if len(g) >= tpl.MIN_TOKENS}
        if large:
            want[host] = large
    slim = df.select(tpl.host_of("url").alias("host"), "html", F.xxhash64("html").alias("key"))
    got = {r.host: {frozenset(c) for c in r.classes} for r in tpl.templates(slim).collect()}
    assert got == want and len(want) > 3


@pytest.mark.parametrize("html, text", [
    ("<article><p>Euler: <math><mi>e</mi> = 2.718</math> holds.</p></article>", "Euler: e = 2.718 holds."),
    ("<article><object>shown instead</object><noscript><p>plain</p></noscript></article>", "shown instead\n\nplain")])
def test_text_of_other_elements_stays(html, text):
    assert tpl.extract(html, []) == text


def test_templates_joined_by_host_give_the_same(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    first = Counter((r.page_id, r.url, r.text, r.n_chars) for r in tpl.main_text(df).collect())
    monkeypatch.setattr(tpl, "SENT_TOKENS", -1)
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in tpl.main_text(df).collect()) == first


def test_text_of_the_given_pages(spark):
    from html import unescape
    df = spark.read.parquet(f"{SF}/pages.parquet")
    pages = {r.page_id: r.html for r in df.collect()}
    for r in tpl.main_text(df).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(p for p in parts if p)
