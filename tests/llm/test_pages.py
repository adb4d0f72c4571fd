"""HTML extraction, WARC transactions and preference pairs."""

import gzip
import hashlib
import random
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import chat, html, queries, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Fish &amp; chips&nbsp;today</h1><p>First   line<br>goes
on.<div class="advert">Buy!</div><p>Second &lt;b&gt; <b>bold</b>word &#8212; &eacute;.<form><input value=x>Mail</form><ul><li>one<li>two</ul>
<table><tr><td>a</td><td>b</td></tr></table><section id="comments"><p>Nice post</p></section></article>
<aside>Related</aside><footer>&copy; 2020</footer></body></html>"""


def test_article_without_its_surroundings():
    named, blocks = html.blocks_of(PAGE)
    assert named
    assert blocks == ["Fish & chips today", "First line goes on.", "Second <b> boldword — é.", "one", "two", "a b"]


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "plain text", "<!-- open", "<script>open", "<p>a<p>b</div></p>", "&#xD800;&#0;&bogus;", "<a href='x>y'>t</a>", "<div" + "<div>" * 3000 + "x"])
def test_odd_pages_do_not_fail(page):
    assert isinstance(html.blocks_of(page)[1], list)


def test_forms_link_regions_and_inline_parts():
    wrapped = "<body><form id=aspnet><div class=menu>Home</div><article><h1>T</h1><p>text <span class=ad>Buy</span> goes <button>Go</button>on</p><form>Mail</form></article><input></form></body>"
    assert html.blocks_of(wrapped) == (True, ["T", "text goes on"])
    assert html.blocks_of("<form><p>all in a form</p><label>Name</label></form>") == (False, ["all in a form"])
    assert html.blocks_of("<p>text</p><form><p>Your mail</p></form>") == (False, ["text"])
    related = "<article><p>text</p><section class=related><p>{}</p><p><a href=/x>More of this kind</a></p></section><p>end</p></article>"
    assert html.blocks_of(related.format("See")) == (True, ["text", "end"])
    assert html.blocks_of(related.format("A long account of what is related to it")) == (True, ["text", "A long account of what is related to it", "More of this kind", "end"])
    assert html.blocks_of("<main><p>a</p><article>one</article><article>two</article></main>") == (True, ["one", "two"])


class Naive(HTMLParser):
    """Text of article elements by the standard library's parser; enough for pages with plain blocks only."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.blocks = 0, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.blocks[-1] += " " * (tag == "br")
        self.blocks += [""] * (tag in ("h1", "p"))

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.blocks += [""] * (tag in ("h1", "p", "article"))

    def handle_data(self, data):
        self.blocks[-1] += data * (self.inside > 0)

    def text(self):
        return "\n\n".join(" ".join(b.split()) for b in self.blocks if b.strip())


def test_extraction_query_against_another_parser(spark):
    sf_dir = "/root/testdata/sf0.01"
    expected = {r["page_id"]: Naive(r["html"] or "").text() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r["page_id"]: r["text"] for r in queries.op7_html(spark, sf_dir).collect()} == expected


def test_open_pages_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st"])
    menus = [" ".join(word() + str(rng.randrange(30)) for _ in range(rng.randint(4, 12))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(menus) if rng.random() < 0.4 else " ".join(word() + str(rng.randrange(60)) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 5))]
        rows.append((i, f"http://{rng.choice('ab')}.example/{i}", "".join(f"<p>{p}</p>" for p in parts)))
    rows += [(100 + r[0], r[1] + "copy", r[2]) for r in rows[:20] for _ in range(2)]
    by_host = {}
    for _, url, page in rows:
        by_host.setdefault(url.split("/")[2], set()).add(page)
    expected = {}
    for key, url, page in rows:
        words = lambda p: [w for b in p[3:-4].split("</p><p>") for w in b.split(" ")]
        grams = [set(zip(*(words(p)[k:] for k in range(html.DEPTH)))) for p in by_host[url.split("/")[2]]]
        own = words(page)
        gone = set()
        for k in range(len(own) - html.DEPTH + 1):
            if sum(tuple(own[k : k + html.DEPTH]) in g for g in grams) >= html.MIN_PAGES:
                gone |= set(range(k, k + html.DEPTH))
        at, blocks = 0, []
        for b in page[3:-4].split("</p><p>"):
            n = len(b.split(" "))
            blocks.append(" ".join(own[j] for j in range(at, at + n) if j not in gone))
            at += n
        expected[key, page] = "\n\n".join([b for b in blocks if b] or page[3:-4].split("</p><p>"))
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    pages = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) and {(r["page_id"], pages[r["page_id"]]): r["text"] for r in got} == expected
    assert any(text != page[3:-4].replace("</p><p>", "\n\n") for (_, page), text in expected.items())


def test_repeated_substrings_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        streams = [rng.integers(0, 3, rng.integers(0, 30)) for _ in range(rng.integers(1, 7))]
        expected = [np.zeros(len(s), bool) for s in streams]
        seen: dict = {}
        for p, s in enumerate(streams):
            for i in range(len(s) - 3):
                seen.setdefault(tuple(s[i : i + 4].tolist()), []).append((p, i))
        for places in seen.values():
            if len({p for p, _ in places}) >= 3:
                for p, i in places:
                    expected[p][i : i + 4] = True
        got = html.covered(streams, depth=4, min_pages=3)
        assert all(np.array_equal(a, b) for a, b in zip(got, expected, strict=True))


def test_boilerplate_without_markup(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    own = [" ".join(word() for _ in range(40)) for _ in range(5)]
    footer = "all rights reserved by the owner of this site"
    rows = [(i, f"http://h.example/{i}", f"<p>{t}</p><p>{footer}</p>") for i, t in enumerate(own)] + [(9, "http://other.example/", f"<p>{own[0]}</p><p>{footer}</p>")]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == own
    assert got[9] == f"{own[0]}\n\n{footer}"


def test_repeats_count_over_all_pages_of_a_large_host(spark, monkeypatch):
    monkeypatch.setattr(html, "SHARD", 1000)
    rng = random.Random(7)
    own = [" ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(50)) for _ in range(120)]
    three, two = "printed on three pages of this host only", "two pages are too few for a repeat here"
    more = {5: three, 60: three, 118: three, 7: two, 90: two}
    rows = [(i, f"http://Big.example/{i}", f"<p>{t}</p><p>{more.get(i, '')}</p>") for i, t in enumerate(own)] + [(500, "http://small.example/", f"<p>{own[1]}</p><p>{three}</p>")]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"{t}\n\n{two}" if more.get(i) == two else t for i, t in enumerate(own)} | {500: f"{own[1]}\n\n{three}"}


def test_pages_edges(spark):
    rows = [(1, None, None, "x"), (None, "odd", "<p>t", "x"), (2, "", "", "x"), (2, "", "", "x"), (3, "http://a/", "<article>" + "<p>long words</p>" * 20000 + "</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.main_text(pages).collect()
    assert len(got) == 5 and {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.main_text(pages.limit(0)).isEmpty()
    path = warc.write_archives(pages)
    found = warc.assemble(warc.read_records(spark, path, payload=True)).collect()
    assert len(found) == 5 and all(r["request"] and r["metadata"] for r in found)
    assert {bytes(r["response"]["payload"]).decode() for r in found} == {r[2] or "" for r in rows}
    assert warc.assemble(warc.read_records(spark, warc.write_archives(pages.limit(0)))).isEmpty()


def test_extraction_query_keeps_every_page(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = queries.op7_html(spark, sf_dir)
    assert got.count() == pages.count()
    assert got.where("text rlike '(?i)</?(p|div|nav|script)\\\\b[^>]*>' or n_chars <> length(text)").isEmpty()
    assert got.where("n_chars > 0").count() > 0.8 * pages.count()


# --- WARC


def test_equal_payloads_are_revisits(spark, tmp_path):
    big, small = "<p>" + "é" * 600, "<p>tiny"
    rows = [(1, "http://a/x", big), (5, "http://b/y\r\nHost: evil", big), (3, "http://a/z", big), (7, "u", small), (8, "u", small)]
    path = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w", records_per_file=4)
    found = {r["page_id"]: r for r in warc.assemble(warc.read_records(spark, path, payload=True)).collect()}
    assert {k: (r["kind"], r["refers_to_page"]) for k, r in found.items()} == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 7: ("response", None), 8: ("response", None)}
    for key, _, page in rows:
        r = found[key]["response"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(page.encode()), hashlib.sha1(page.encode()).hexdigest())
    # plain files that any reader of the format can take apart
    kinds = []
    for f in sorted((tmp_path / "w").glob("*.gz")):
        with gzip.open(f) as stream:
            kinds += [fields["warc-type"] for fields, _ in warc.parse(stream)]
    assert sorted(kinds) == ["metadata"] * 5 + ["request"] * 5 + ["response"] * 3 + ["revisit"] * 2


def test_cut_archive_is_an_error():
    import io

    with pytest.raises(ValueError):
        warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort"))
    with pytest.raises(ValueError):
        warc.parse(io.BytesIO(b"HTTP/1.1 200 OK\r\n"))


# --- preferences


def naive_preferences(c, r):
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1
    show = lambda turns: "".join(f"<|{a}|>\n{b}<|end|>\n" for a, b in turns)
    mask = lambda turns: " ".join(f"{len(a) + 5}:0 {len(b) + 8}:{int(a == 'assistant')}" for a, b in turns)
    return n, show(c[:n]), show(c[n:]), mask(c[n:]), show(r[n:]), mask(r[n:])


def test_pairs_against_brute_force(spark):
    rng, rows, expected = random.Random(6), [], {}
    for pair in range(60):
        c = [(rng.choice(["user", "assistant"]), rng.choice(["a", "b c", "é🙂", ""])) for _ in range(rng.randint(0, 6))]
        r = [*c[: rng.randint(0, len(c))], *((rng.choice(["user", "assistant"]), rng.choice("xy")) for _ in range(rng.randint(0, 3)))]
        for chosen, turns in ((True, c), (False, r)):
            rows += [(pair, chosen, i, a, b) for i, (a, b) in enumerate(turns)]
        if c or r:
            expected[pair] = naive_preferences(c, r)
    rng.shuffle(rows)
    got = chat.preferences(chat.sides(spark.createDataFrame(rows, "pair_id long, chosen boolean, turn int, role string, text string"))).collect()
    assert {r["pair_id"]: tuple(r[1:7]) for r in got} == expected
    for r in got:
        for side in ("chosen", "rejected"):
            assert sum(int(x.split(":")[0]) for x in r[f"{side}_mask"].split()) == len(r[side])


def test_conversation_edges(spark):
    rows = [(2, 1, "user", "hi", 1), (2, 2, "assistant", None, 1), (2, 2, "assistant", None, 1), (3, None, None, "hi", 1), (None, 1, "user", "lost", 1), (8, 1, "user", "alone" * 50000, 1), (10, 1, "user", "same", 1), (11, 1, "user", "same", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt int")
    got = {r["pair_id"]: r for r in chat.preferences(chat.branched(turns)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {2: "pair", 3: "pair", 8: "no rejected", 10: "equal", 11: "equal"}
    assert got[2]["prompt_turns"] == 2 and got[3]["rejected"] == "<|user|>\nhi<|end|>\n" + 2 * "<|assistant|>\n<|end|>\n"
    assert chat.preferences(chat.branched(turns.limit(0))).isEmpty()


def test_preferences_are_native(spark, sf_dir):
    plan = queries.op10_preferences(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "BatchEval", "ExistingRDD"))
    # the query's pairs part at the first turn, at the last one and between
    assert queries.op10_preferences(spark, sf_dir).where("prompt_turns = 0").count() > 0
    assert queries.op10_preferences(spark, sf_dir).select("prompt_turns").distinct().count() > 2
