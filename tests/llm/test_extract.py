"""Page text: blocks, zones, the suffix array against plain counting, odd pages."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from plumbline.llm import extract as X

FILLER = "words{0} of{0} the{0} story{0} that{0} nobody{0} else{0} tells{0}, with{0} an{0} end"


def page(body, notice="We use small files to remember you; go on reading and you agree to them all."):
    return f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x:1}}</style><script>var t="</p><p>no";</script><body>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy this now</div>{body}<div>{notice}</div>
<div id="comments"><p>First!</p></div><aside>Other stories</aside><form><p>Your name <input></form><footer>&copy; us</footer></html>"""


def test_blocks_and_zones():
    html = page("<article><header><h1>A &amp; B</h1></header><p><b>One\n two<br>three &lt;4<p>Five<!-- x --> six &#233;<ul><li>a<li>b</ul><section class='related'>See also</section></article>")
    kept = [t for t, z, _, _ in X.blocks(html) if z == X.CONTENT]
    assert kept == ["A & B", "One two three <4", "Five six é", "a", "b"]
    assert X.blocks("") == [] and X.blocks("1 < 2 and <3") == [("1 < 2 and <3", X.OPEN, "", False)]
    assert [t for t, z, _, _ in X.blocks("<head><title>x</title><p>no end tag") if z == X.OPEN] == ["no end tag"]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>Hello world <span class='share'>Tweet</p><p>next", "Hello world\n\nnext"),
        ("<p>a <span class='share'>Tweet this</span> b</p>", "a b"),
        ("<div id='content' class='post-side'>all of it</div>", "all of it"),
        ("<article><div class='legal'>of law</div><p class='notice'>of notices</p></article>", "of law\n\nof notices"),
        ("<main><p>x</p><article class='comment'>no</article></main>", "x"),
        ("<p>a <math>x+1</math> b <button>Go</button> c</p>", "a x+1 b c"),
        ('<p><a href="x>text</a> more "quoted" words</p>', 'text more "quoted" words'),
        ('<p title="a>b">t <i data-x=\'>\'>u</i></p>', "t u"),
        ("<div role=main><p>x</p></div><div>beside it</div>", "x"),
        ("<p>a<ul><li>b<li>c</ul></i></b>d", "a\n\nb\n\nc\n\nd"),
    ],
)
def test_odd_markup(html, text):
    assert X.main_text(X.blocks(html), set()) == text


@pytest.mark.parametrize("part", ["<a", "<a ", '<a x="', '<a x=">" ', "<", "<div>", "<!--", "<li><b>", "</i>", "<p><b>", "&", "<script ", "<a x='>"])
def test_a_megabyte_of_anything_takes_seconds(part):
    began = time.time()
    X.blocks(part * (1_000_000 // len(part)))
    X.blocks("<b>x" * 100_000 + "</i>" * 100_000)
    assert time.time() - began < 20


def test_suffix_array_counts_as_plain_counting_does():
    rng = random.Random(3)
    pages = []
    for key in range(30):
        found = [(rng.choice(["a", "b.c"]), rng.random() < 0.5, rng.choices("abcd", k=rng.randint(1, 30)), None) for _ in range(rng.randint(0, 4))]
        pages.append((key * 7 % 30, found))
    zones, runs = X.shard_runs(pages, 4)
    keys, places, want_zone = defaultdict(set), [], defaultdict(lambda: [set(), 0, 0])
    for key, found in pages:
        for path, unmarked, words, _ in found:
            for i in range(max(1, len(words) - 3)):
                run = tuple(words[i : i + 4])
                keys[run].add(key)
                places.append((path, key, run, unmarked))
    for path, key, run, _ in places:
        zone = want_zone[path]
        zone[0].add(key)
        zone[1] += 1
        zone[2] += len(keys[run]) > 1
    assert sorted(zones) == sorted((p, len(z[0]), z[1], z[2]) for p, z in want_zone.items())
    assert sorted(runs) == sorted({(X.run_hash(list(r)), min(keys[r]), max(keys[r])) for _, _, r, unmarked in places if unmarked})


def test_runs_decide_where_names_say_nothing(spark):
    """Zones without a telling name: most of their runs repeat, so all of them go, also texts of one page only."""
    rows = []
    for i in range(30):
        head = f"<div class='xq'>Read the paper of the town and its {('river', 'hills', 'roads')[i % 3]} every day</div>" if i else "<div class='xq'>Only here stands this text in the zone of the head</div>"
        body = f"<article><p>{FILLER.format(i)}</p><div class='zz'>Written by the staff of this paper for you and yours</div><p class='notice'>{FILLER.format(i + 900)}</p></article>"
        rows.append((i, f"http://a.example/{i}", head + body))
    rows += [(99, "http://small.example/", f"<div class='xq'>nothing that repeats here</div><article><p>{FILLER.format(99)}</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in X.extract(df).collect()}
    for i in range(30):
        assert got[i] == f"{FILLER.format(i)}\n\n{FILLER.format(i + 900)}"
    assert got[99] == FILLER.format(99)
    untouched = [X.main_text(X.blocks(h), set()) for _, _, h in rows[:30]]
    assert all("Written by" in t for t in untouched)  # without the runs it would stay


def test_boilerplate_goes_and_copies_stay(spark):
    notice = "This notice is on every page of the host and says nothing at all about it"
    rows = []
    for i in range(40):  # no content element: repeats decide
        rows.append((i, f"http://a.example/{i}", f"<div>{notice}</div><div>{FILLER.format(i)}</div><div>{notice} but {i}</div>", "x"))
    for i in range(40, 60):  # copies of an article
        rows.append((i, f"http://b.example/{i}", page(f"<article><p>{FILLER.format(0)}</p><p>{FILLER.format(7)}</p></article>"), "x"))
    for i in range(60, 70):  # copies of a page without a content element
        rows.append((i, "http://c.example/", f"<div>{FILLER.format(3)}</div>", "x"))
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])
    df = spark.createDataFrame(rows, schema)
    for shard, known in ((400, 1 << 20), (4 << 20, 1 << 20), (4 << 20, 0)):
        got = {r.page_id: r for r in X.extract(df, shard_bytes=shard, known_items=known).collect()}
        assert len(got) == 70 and all(got[i].text == FILLER.format(3) for i in range(60, 70))
        for i in range(40):
            assert got[i].text == f"{FILLER.format(i)}\n\n{i}"  # "but" is on every page too
        for i in range(40, 60):
            assert got[i].text == f"{FILLER.format(0)}\n\n{FILLER.format(7)}" and got[i].n_chars == len(got[i].text)


def test_odd_pages(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
    rows = [(1, None, "<p>a b"), (2, "x", None), (3, "", ""), (None, "http://h", "<article>" + "<p>long text " * 20000), (3, "", ""), (4, "http://h", "<<>>&bogus;"), (5, "http://h", "<script>never ends")]
    got = sorted(((r.page_id, r.url, r.text[:9], r.n_chars) for r in X.extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, None, "a b", 3), (2, "x", "", 0), (3, "", "", 0), (None, "http://h", "long text", 20000 * 9 + 2 * 19999), (3, "", "", 0), (4, "http://h", "<<>>&bogu", 11), (5, "http://h", "", 0)], key=str)
    assert X.extract(spark.createDataFrame([], schema)).collect() == []


def test_real_pages_keep_the_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in X.extract(pages).collect():
        inside = html[r.page_id].split("<article>")[1].split("</article>")[0]
        outside = html[r.page_id].replace(inside, "")
        assert r.n_chars == len(r.text) and "<p>" not in r.text
        plain = "".join(c for c in X.html.unescape(X.re.sub(r"<[^>]*>", " ", inside)) if not c.isspace())
        assert "".join(r.text.split()) == plain and "©" in X.html.unescape(outside)


def test_names_are_taken_whole(spark):
    kept = ["<div class='related-work'>{}</div>", "<section class='share-prices'>{}</section>", "<p class='form'>{}</p>", "<div class='comment-on-markets'>{}</div>", "<h2 id='sidebar'>{}</h2>", "<div class='social-science'>{}</div>", "<div id='advert7 analysis'>{}</div>"]
    gone = ["<div class='related-posts'>{}</div>", "<div class='share-buttons'>{}</div>", "<div id='ad-slot-2'>{}</div>", "<section class='comments-list'>{}</section>", "<div class='xx cookie'>{}</div>", "<aside>{}</aside>", "<div class='reply'><p>{}</p></div>"]
    for i, one in enumerate(kept[:-1]):
        assert X.main_text(X.blocks(f"<article>{one.format(FILLER.format(i))}</article>"), set()) == FILLER.format(i), one
    for i, one in enumerate([*gone, kept[-1]]):
        assert X.main_text(X.blocks(f"<article><p>body</p>{one.format(FILLER.format(i))}</article>"), set()) == "body", one


def test_runs_clear_what_names_condemn(spark):
    """An aside whose text is another on every page is part of the article; one that repeats is none; comments never are."""
    rows = []
    for i in range(30):
        parts = f"<p>{FILLER.format(i)}</p><aside>{FILLER.format(i + 100)}</aside><div class='promo'>Join the club of the readers of this paper now and pay less</div><div class='comments'>{FILLER.format(i + 200)}</div>"
        rows.append((i, f"http://a.example/{i}", f"<nav>{FILLER.format(i + 300)}</nav><article>{parts}</article>"))
        rows.append((100 + i, f"http://b.example/{i}", f"<div class='sidebar'>{FILLER.format(i + 400)}</div><div>{FILLER.format(i + 500)}</div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for known in (1 << 20, 0):
        got = {r.page_id: r.text for r in X.extract(df, known_items=known).collect()}
        for i in range(30):
            assert got[i] == f"{FILLER.format(i)}\n\n{FILLER.format(i + 100)}"
            assert got[100 + i] == f"{FILLER.format(i + 400)}\n\n{FILLER.format(i + 500)}"
    assert X.main_text(X.blocks(rows[0][2]), set()) == FILLER.format(0)  # by names alone the aside goes


def test_runs_decide_on_real_pages(spark):
    """Real pages whose elements and classes are renamed, articles too, so that no name tells anything: runs find whole texts, nothing known finds none."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {r.page_id: r.text for r in X.extract(pages).collect()}

    def renamed(html):
        html = X.re.sub(r"<(/?)(?:nav|aside|footer|header|form|section|article|main)\b", r"<\1div", html)
        return X.re.sub(r"\b(class|id)=([\"']?)([a-z-]+)", lambda m: f"{m[1]}={m[2]}q{''.join(chr(97 + (ord(c) * 7) % 26) for c in m[3])}", html)

    rows = [(r.page_id, r.url, renamed(r.html)) for r in pages.collect()]
    got = {r.page_id: r.text for r in X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    bare = {i: X.main_text(X.blocks(html), set()) for i, _, html in rows}
    assert sum(got[i] == want[i] for i in want) > 800 and not any(bare[i] == want[i] for i in want)

    def beside(found):
        """Words that aren't in the article, of all pages."""
        inside = {i: set(t.split()) for i, t in want.items()}
        return sum(sum(w not in inside[i] for w in t.split()) for i, t in found.items())

    assert beside(got) < 0.25 * beside(bare)
