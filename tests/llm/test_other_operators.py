"""Operators on pages, conversations and vectors against brute force, and the cases that their docstrings define."""

import gzip
import hashlib
import html.parser
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparsecg.llm import chat_tree, embed_tiles, html_blocks, html_crf, html_pages, warc
from sparsecg.llm.common import components
from sparsecg.llm.queries import tokenizer_path

# --- pages ----------------------------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string, text string, row string"
WHOLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="ad">Buy  now.</div>
<article><h1>Tom &amp; Ann&#39;s &eacute;t&eacute</h1><p><b>First   <i>part</i>
 of it.</b><br><p>Second &lt;b&gt; part</article>
<aside>Other news today.</aside><footer>&copy; site.example.com all rights.</footer></body>"""


def test_main_text(spark):
    rows = [(1, "u", WHOLE), (1, "u", WHOLE), (2, None, None), (3, "u", ""), (None, "u", "no markup"), (5, "u", "<article><p>" + "long text. " * 50_000 + "</p>"), (6, "u", "<p>open <b"), (7, "u", "<<<>>> &#0; &#xD800; &bogus; \x00")]
    got = [r for r in html_crf.main_text(spark.createDataFrame([(*r, "x", None) for r in rows], PAGE)).collect()]
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "Tom & Ann's été\nFirst part of it.\nSecond <b> part"
    assert by[2] == by[3] == "" and by[5] == ("long text. " * 50_000).strip()
    assert html_crf.main_text(spark.createDataFrame([], PAGE)).count() == 0


def accuracy(model, layouts, n=150):
    """Precision, recall of main blocks and share of pages that are right whole, on pages that training hasn't seen."""
    met, wrong, missed, whole = 0, 0, 0, 0
    test = html_crf.labelled(html_pages.pages(n, seed=11, layouts=layouts))
    for page, labels in test:
        got = model.decode(model.scores(page))
        met += sum(a and b for a, b in zip(got, labels, strict=True))
        wrong += sum(a and not b for a, b in zip(got, labels, strict=True))
        missed += sum(b and not a for a, b in zip(got, labels, strict=True))
        whole += got == labels
    return met / (met + wrong), met / (met + missed), whole / len(test)


@pytest.mark.parametrize("layout", html_pages.LAYOUTS)
def test_held_out_pages_by_layout(layout):
    precision, recall, whole = accuracy(html_crf.default_model(), (layout,))
    assert precision > 0.98 and recall > 0.98 and whole > 0.92


@pytest.mark.parametrize("layout", html_pages.LAYOUTS)
def test_layouts_that_training_never_saw(layout):
    model = html_crf.train(html_crf.labelled(html_pages.pages(400, seed=5, layouts=tuple(x for x in html_pages.LAYOUTS if x != layout))))
    precision, recall, _ = accuracy(model, (layout,))
    assert precision > 0.95 and recall > 0.95


SITES = [
    ("<p>Only a paragraph, and nothing else around it.</p><p>The second one ends here.</p>", "Only a paragraph, and nothing else around it.\nThe second one ends here."),
    ("<div class=kopf><a href=/>Startseite</a></div><div class=inhalt><h1>Überschrift</h1><p>Ein Absatz.</p></div><div class=seitenleiste>Mehr davon</div><div id=fusszeile>Impressum</div>", "Überschrift\nEin Absatz."),
    ("<table><tr><td><a href=/>Home</a> <a href=/n>News</a><tr><td>The story of the page stands in this cell. It has two sentences.</table>", "The story of the page stands in this cell. It has two sentences."),
    ("<header>Site</header><article><header><h1>Title in a header</h1></header><p>Text.</p></article><footer>All rights.</footer>", "Title in a header\nText."),
    ("<div class=x1><div><a href=/>One</a><a href=/>Two</a></div><div class=q7><div>A long text without any name around it, which goes on for a while. It has sentences.</div></div></div>", "A long text without any name around it, which goes on for a while. It has sentences."),
    ("<main><h1>Terms</h1><dl><dt>First<dd>What it means.<dt>Second<dd>What that means.</dl></main><nav><a href=/>Up</a></nav>", "Terms\nFirst\nWhat it means.\nSecond\nWhat that means."),
]


@pytest.mark.parametrize(("page", "text"), SITES)
def test_sites(page, text):
    assert html_crf.extract(html_crf.default_model(), page) == text


def test_whole_texts_against_labels(spark):
    made = html_pages.pages(120, seed=31)
    df = spark.createDataFrame([(i, "u", m, "x", None) for i, (m, _) in enumerate(made)], PAGE)
    got = {r.page_id: r.text for r in html_crf.main_text(df).collect()}
    assert sum(got[i] == "\n".join(says) for i, (_, says) in enumerate(made)) > 0.93 * len(made)


LONG = {
    "rows": "<table>" + "<tr><td>a<td>b" * 70_000,
    "items": "<dl>" + "<dt>a<dd>b" * 100_000,
    "quotes": "<article>" + '<p title=">a' * 80_000,
    "stray quotes": "<article>" + "<p \">a<i '>b" * 80_000,
    "deep": "<div class=a>" * 80_000,
    "unmatched ends": "<div>" * 30_000 + "</b></i></li></section>" * 40_000,
    "open comments": "<!-- a " * 150_000,
    "open tags": "<a href=" * 120_000,
    "signs": "<<" * 500_000,
    "raw": "<svg><noscript><button>" * 45_000,
    "spaces": "<p a" + " " * 1_000_000 + "=x>a",
}


@pytest.mark.parametrize("kind", LONG)
def test_long_odd_pages_take_time_and_memory_in_proportion(kind):
    import time
    import tracemalloc

    model = html_crf.default_model()
    began = time.process_time()
    html_crf.extract(model, LONG[kind])
    assert time.process_time() - began < 15
    tracemalloc.start()
    html_crf.extract(model, LONG[kind][: 1 << 18])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    model = html_crf.Crf(np.zeros(html_crf.FEATURES), rng.normal(size=(2, 2)), rng.normal(size=2))
    scores = rng.normal(size=7)
    best = max(range(128), key=lambda k: sum((k >> i & 1) * scores[i] for i in range(7)) + model.first[k & 1] + sum(model.trans[k >> i & 1, k >> i + 1 & 1] for i in range(6)))
    assert model.decode(scores.tolist()) == [bool(best >> i & 1) for i in range(7)]


@given(st.text(alphabet=st.sampled_from("<>/=\"' !-pabdivscript&;#x1\n"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read(page):
    assert all(b.text.strip() == b.text and b.text for b in html_blocks.read(page).blocks)


def test_warc(spark):
    rows = [(1, "http://a.example/x", WHOLE), (2, None, None), (None, "u\r\nX: y", "<p>é\n"), (3, "v", "")]
    got = warc.derivatives(spark.createDataFrame([(*r, None, None) for r in rows], PAGE)).collect()
    assert len(got) == 3 * len(rows)
    names = {r.record_id for r in got}
    assert len(names) == len(got)
    for r in got:
        (one,) = warc.parse(bytes(r.record))
        h, block = dict(one.headers), one.block
        assert not one.error and h["WARC-Type"] == r.record_type and h["WARC-Record-ID"] == r.record_id and h["WARC-Block-Digest"] == warc.digest(block) == r.block_digest
        assert len(block) == r.content_length
        if r.record_type != "response":
            assert h["WARC-Refers-To"] == r.refers_to in names
            source = next(s for s in got if s.record_id == r.refers_to)
            sh = dict(next(warc.parse(bytes(source.record))).headers)
            assert all(h[k] == sh[k] for k in warc.KEPT) and h["WARC-Source-Payload-Digest"] == sh["WARC-Payload-Digest"]
    text = next(next(warc.parse(bytes(r.record))).block for r in got if r.page_id == 1 and r.record_type == "conversion").decode()
    assert "Tom & Ann's été" in text and "<" not in text.replace("<b>", "")
    assert len([*warc.parse(b"".join(bytes(r.record) for r in got))]) == len(got)
    derived = warc.derivatives_of(spark.createDataFrame([(bytearray(r.record),) for r in got if r.record_type == "response"] + [(None,)], "record binary")).collect()
    assert {bytes(r.record) for r in derived} == {bytes(r.record) for r in got if r.record_type != "response"}
    again = warc.derivatives(spark.createDataFrame([(*r, None, None) for r in rows], PAGE)).collect()
    assert sorted(r.record_id for r in again) == sorted(names)
    assert warc.derivatives(spark.createDataFrame([], PAGE)).count() == 0


class Plain(html.parser.HTMLParser):
    """Title, language, link targets and all shown words of a page, by the standard library's reader."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.title, self.lang, self.links, self.words, self.within = "", "", [], [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "html":
            self.lang = found.get("lang") or ""
        if tag == "a" and found.get("href") is not None:
            self.links.append(found["href"])
        if tag in ("title", "script", "style", "button", "select", "svg"):
            self.within.append(tag)

    def handle_endtag(self, tag):
        if self.within and self.within[-1] == tag:
            self.within.pop()

    def handle_data(self, data):
        if self.within[-1:] == ["title"]:
            self.title += data
        elif not self.within:
            self.words += data.split()


def test_derivatives_against_another_reader():
    for k, (page, _) in enumerate(html_pages.pages(150, seed=77)):
        plain = Plain(page)
        made = {dict(h)["WARC-Type"]: b.decode() for h, b in warc.derive(*warc.response(k, "u", page))}
        fields = [tuple(x.split(": ", 1)) for x in made["metadata"].split("\r\n") if x]
        assert [v for n, v in fields if n == "outlink"] == plain.links
        assert ("title", " ".join(plain.title.split())) in fields and ("languageOfPage", plain.lang) in [(n, v) for n, *r in fields for v in r] + [("languageOfPage", "")] * (not plain.lang)
        # the same signs in the same order; blocks and inline tags cut words differently
        assert "".join(made["conversion"].split()) == "".join(plain.words)
        assert ("textLength", str(len(made["conversion"].encode()))) in fields and ("payloadLength", str(len(page.encode()))) in fields


def foreign(payload, *http, version="WARC/1.0", name="warc-record-id", more=""):
    block = "\r\n".join(["HTTP/1.1 200 OK", *http, "", ""]).encode() + payload
    head = f"{version}\r\nwarc-type: response\r\n{name}: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\n{more}content-length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def conversion(raw):
    records = [*warc.parse(raw)]
    made = [d for r in records if not r.error for d in warc.derive(r.headers, r.block)]
    return {dict(h)["WARC-Type"]: b.decode() for h, b in made}


PAYLOADS = [
    ("<p>café".encode("latin-1"), ["Content-Type: text/html; charset=ISO-8859-1"], "café"),
    ("<p>naïve".encode("cp1252"), ["content-type: text/html;charset=windows-1252"], "naïve"),
    ('<meta charset="iso-8859-2"><p>łódź'.encode("iso-8859-2"), [], "łódź"),
    ('<meta http-equiv=x content="text/html; charset=koi8-r"><p>слово'.encode("koi8-r"), ["Content-Type: text/html"], "слово"),
    ("<p>wide".encode("utf-16"), [], "wide"),
    ("<p>é".encode(), ["Content-Type: text/html; charset=no-such-set"], "é"),
    (gzip.compress("<p>packed é".encode()), ["Content-Encoding: gzip", "Content-Type: text/html; charset=utf-8"], "packed é"),
    (zlib.compress(b"<p>deflated"), ["content-encoding: deflate"], "deflated"),
    (b"5\r\n<p>ch\r\n4;x=y\r\nunks\r\n0\r\n\r\n", ["Transfer-Encoding: chunked"], "chunks"),
    (b"<p>plain under a wrong header", ["Content-Encoding: gzip"], "plain under a wrong header"),
    (b"a < b\n c", ["Content-Type: text/plain"], "a < b\n c"),
]


@pytest.mark.parametrize(("payload", "http", "text"), PAYLOADS)
def test_payloads_are_read_as_their_headers_say(payload, http, text):
    assert conversion(foreign(payload, *http))["conversion"] == text


def test_payloads_that_are_no_text():
    for payload, http in ((b"\x89PNG", ["Content-Type: image/png"]), (b"xx", ["Content-Encoding: br"]), (b"\x1f\x8bbroken", ["Content-Encoding: gzip"])):
        assert set(conversion(foreign(payload, *http))) == {"metadata"}


def test_foreign_records(spark):
    many = foreign(b"<p>one", more="X-Long: a\r\n  folded\r\nX-Twice: 1\r\nX-Twice: 2\r\n") + b"junk\r\n" + foreign(b"<p>two", version="WARC/0.18") + foreign(b"<p>three")[:-30]
    records = [*warc.parse(many)]
    assert [r.error for r in records] == ["", "no version line", "", "a block cut short"]
    assert [v for k, v in records[0].headers if k == "X-Twice"] == ["1", "2"] and warc.header(records[0].headers, "x-long") == "a folded"
    assert b"sourceWarcHeader: X-Twice: 2" in warc.derive(records[0].headers, records[0].block)[1][1]
    assert [r.error for r in warc.parse(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n")] == ["no length"]
    got = warc.derivatives_of(spark.createDataFrame([(bytearray(many),), (bytearray(b""),), (None,)], "record binary")).collect()
    assert sorted(r.record_type for r in got) == ["conversion", "conversion", "malformed", "malformed", "metadata", "metadata"]
    assert b"".join(r.block for r in records if r.error) == b"".join(bytes(r.record) for r in got if r.record_type == "malformed")


@given(st.lists(st.sampled_from([b"WARC/1.0\r\n", b"Content-Length: 3\r\n", b"\r\n", b"abc", b"\n", b"content-length: x\r\n", b": \r\n", b"WARC/1.1\n", b"\xff"]), max_size=14).map(b"".join))
@settings(max_examples=300, deadline=None)
def test_any_bytes_are_read(raw):
    for r in warc.parse(raw):
        warc.derive(r.headers, r.block)


# --- conversations --------------------------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string, node string, depth int"
_PIECE = st.sampled_from(["<|turn|>", "<|end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "|", "[", "\n", "é", "a", "<\\|", "n"])


@given(st.lists(st.tuples(st.lists(_PIECE, max_size=5).map("".join), st.lists(_PIECE, max_size=9).map("".join)), max_size=5))
@settings(max_examples=300, deadline=None)
def test_format_round_trip(turns):
    formatted = "".join(chat_tree.OPEN + chat_tree.role_escape(r) + chat_tree.BREAK + chat_tree.escape(t) + chat_tree.CLOSE for r, t in turns)
    assert chat_tree.parse(formatted) == turns
    assert all(c not in chat_tree.escape(t) for _, t in turns for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_tree(spark):
    rows = []
    for c in range(40):
        rows += [(c, 0, "system", "You help."), (c, 1, "user", f"q{c % 3}"), (c, 2, "assistant", f"a{c % 5} </s>"), (c, 3, "user", None)][: 2 + c % 3]
    rows += [(200, k, "user", f"turn {k}") for k in range(300)] + [(201, k, "user", f"turn {k}") for k in range(150)] + [(201, 150, "user", "else")]
    rows += [(100, 1, "user", "x"), (100, 1, "user", "x"), (100, None, None, ""), (None, 0, "assistant", "é" * 40_000), (101, 5, "role\nodd", "[INST] y")]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], CONV)
    tree = chat_tree.Tree(df, tokenizer_path("byte_bpe_50k.json"))
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    got = {r.conv_id: r for r in tree.read_back().collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    nodes = sorted(tree.nodes.collect(), key=lambda n: n.stream_start)
    assert len(nodes) == len({tuple(t[: k + 1]) for t in by.values() for k in range(len(t))})
    at = 0
    for n in nodes:  # one gapless stream, parents before children, positions that go on from the parent's
        assert n.stream_start == at and len(n.tokens) == n.n_tokens == len(n.position_ids)
        at += n.n_tokens
        spans = [(r.start, r.end) for r in n.attends]
        assert spans == sorted(spans) and spans[-1][1] == at and all(e < s for (_, e), (s, _) in zip(spans, spans[1:], strict=False))
        assert sum(s <= m.stream_start < e for m in nodes for s, e in spans) == n.depth + 1
        assert n.position_ids[0] == sum(e - s for s, e in spans) - n.n_tokens
    inside = lambda n, m: any(r.start <= m.stream_start < r.end for r in n.attends)
    for n in nodes:  # ancestors are those of the parent and the parent, and depth first leaves no gaps in a subtree
        own = [m for m in nodes if inside(n, m)]
        assert [m.depth for m in own] == list(range(n.depth + 1)) and own[-1] is n
        for m in own[:-1]:
            assert all(inside(x, m) for x in nodes if m.stream_start <= x.stream_start <= n.stream_start)
    lone = chat_tree.Tree(spark.createDataFrame([(None, k % 2, "user", f"t{k // 2}", "n", 1) for k in range(6)], CONV), tokenizer_path("byte_bpe_50k.json"))
    assert [(r.conv_id, r.n_turns) for r in lone.read_back().collect()] == [(None, 1)] * 6 and lone.nodes.count() == 3
    empty = chat_tree.Tree(df.where("false"), tokenizer_path("byte_bpe_50k.json"))
    assert empty.nodes.count() == 0 and empty.read_back().count() == 0


# --- vectors --------------------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int, v string, cid long"


def slow_links(rows, threshold=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, reach = {i: 0 for i, _ in rows}, {i: {i} for i, _ in rows}
    for k, (i, a) in enumerate(good):
        for j, b in good[k + 1 :]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                n[i] += 1
                n[j] += 1
                reach[i].add(j)
                reach[j].add(i)
    comp = {}
    for i in sorted(reach):
        if i not in comp:
            stack, found = [i], {i}
            while stack:
                for y in reach[stack.pop()]:
                    if y not in found:
                        found.add(y)
                        stack.append(y)
            comp |= dict.fromkeys(found, i)
    return {i: (n[i], comp[i]) for i, _ in rows}


@pytest.mark.parametrize("tile", [37 * 320, 1 << 20])
def test_vectors(spark, tile):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 40))
    rows = [(i, base[i % 60] + rng.normal(size=40) * rng.choice([0.0, 0.1, 0.3, 0.5])) for i in range(300)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    rows += [(400, rows[0][1]), (401, [2 * x for x in rows[0][1]]), (402, None), (403, []), (404, [0.0] * 40), (405, [float("nan")] + [1.0] * 39), (406, [None] + [1.0] * 39), (407, [float("inf")] * 40), (408, rows[0][1][:8]), (409, rows[0][1][:8]), (410, [1e-30] * 40), (411, [1e30] * 40)]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], VEC)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_tiles.near_duplicates(df, tile_bytes=tile).collect()}
    assert got == slow_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert embed_tiles.near_duplicates(df.where("false")).count() == 0


def plain_cosine(a, b):
    return float(a @ b) / np.sqrt(float(a @ a) * float(b @ b))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_cosine_of_just_the_threshold_links(spark, kind):
    """400 pairs of cosine 0.9, and as many a little below, in dimensions that no other pair uses."""
    rows, want = [], {}
    rng = np.random.default_rng(1)
    for k in range(400):
        at = 5 * (k % 80) + rng.permutation(5)
        a, b = np.zeros(400), np.zeros(400)
        a[at[0]] = 1.0 + k // 80
        b[at] = np.array([9, 4, 1, 1, 1]) * (k // 80 + 1)
        if kind == "double":
            b /= 10
        below = b.copy()
        below[at[1]] *= 1 + 1e-6
        rows += [(3 * k, a, k), (3 * k + 1, b, k), (3 * k + 2, below, k)]
        assert plain_cosine(a, b) >= 0.9 > plain_cosine(a, below)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v, _ in rows], f"vec_id long, embedding array<{kind}>, label int")
    got = {r.vec_id: r.n_links for r in embed_tiles.near_duplicates(df, tile_bytes=1 << 18).collect()}
    vectors = np.array([v if kind == "double" else np.float32(v).astype(float) for _, v, _ in rows])
    dots = vectors @ vectors.T
    norms = np.diag(dots)
    near = dots / np.sqrt(norms[:, None] * norms[None, :])
    sure = (near >= 0.9 + 1e-9).sum(1) - 1  # each with itself
    tie = np.abs(near - 0.9) < 1e-12
    assert tie.sum() >= 800
    want = sure + tie.sum(1)
    assert [got[i] for i, _, _ in rows] == want.tolist()


def test_far_cells_do_not_meet():
    rng = np.random.default_rng(2)
    u = embed_tiles.unit(np.repeat(np.eye(8), 200, 0) + 0.02 * rng.normal(size=(1600, 8)))
    cells = embed_tiles.Cells(u, 16)
    own = cells.cell(u)
    assert cells.count == 16 and np.bincount(own).max() <= 150
    low, high = (np.array([f(u[own == c], 0) for c in range(16)]) for f in (np.min, np.max))
    a, b = embed_tiles.cell_pairs(low, high, 0.9)
    assert len(a) < 16 * 16 / 2
    mixed = embed_tiles.unit(rng.normal(size=(900, 8)))
    cells = embed_tiles.Cells(mixed[:100], 30)
    own = cells.cell(mixed)
    names = np.unique(own)
    low, high = (np.array([f(mixed[own == c], 0) for c in names]) for f in (np.min, np.max))
    met = set(zip(*(names[x].tolist() for x in embed_tiles.cell_pairs(low, high, 0.9)), strict=True))
    x, y = np.nonzero(mixed @ mixed.T >= 0.9)
    assert set(zip(own[x].tolist(), own[y].tolist(), strict=True)) <= met and len(met) < len(names) ** 2


def test_bounds_never_drop_a_pair():
    rng = np.random.default_rng(8)
    u = embed_tiles.unit(np.concatenate([rng.normal(size=(80, 64)), np.repeat(rng.normal(size=(1, 64)), 40, 0) + 0.3 * rng.normal(size=(40, 64))]))
    a, b = embed_tiles.close_pairs(u, u, 0.9)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(u @ u.T >= 0.9 - embed_tiles.SLACK)), strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(50)] + [(130, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[100 + k] == 100 for k in range(50)) and got[200] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
