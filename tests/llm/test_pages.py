import math
import random
from collections import Counter

import pytest

from conftest import sentence
from veilspark.llm import markup, pages

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><div id="page-ads wrap"><article><header><h1>Head&amp;line</h1></header>
<p><b>Bold</b>ly &eacute;t&#233; &lt;3<br>next<p>Second   para <a href="x>y">link</a>.
<aside>aside</aside><div class="comment-list"><p>Reader says</p></div><p>Last &am</article></div>
<form><input>Search</form><footer>&copy; host</footer></body></html>"""


def test_article_text():
    main, outer, chrome = markup.split(ARTICLE)
    assert main == "Head&line Boldly été <3 next Second para link. Last &am"
    marked = {x for x, c in zip(outer, chrome) if c}
    assert {"Site", "Menu", "Buy", "aside", "Reader says", "Search", "© host"} <= marked


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain words", "plain words"),
        ("<p>cut off <b>mid", "cut off mid"),
        ("<p>cut <a href='x", "cut"),
        ("<main><div>in main</div><article class=comment>me</article></main><p>out", "in main"),
        ("<div role=main>a<span class=ad>x</span>b</div>", "a b"),
        ("<article>one</article><p>between<article>two</article>", "one two"),
        ("<article><script>if (a<b) {}</script>x<noscript>turn on</noscript></article>", "x"),
        ("a < b <3 & c", "a < b <3 & c"),
        ("<p class=notice>gone<p>stays", "stays"),
        ("<ul><li>1<li class=share>2<li>3</ul>", "1 3"),
        ("<table><tr><td>a</td><td>b</td></tr></table>", "a b"),
        ("fo<b>o</b><i>b</i>ar", "foobar"),
        ("<p hidden>no</p><p style='display: none'>no</p>yes", "yes"),
    ],
)
def test_small_pages(spark, html, text):
    main, outer, chrome = markup.split(html)
    found = main if main is not None else " ".join(x for x, c in zip(outer, chrome) if not c)
    assert found == text


def site_rows():
    """A host without article elements, whose unmarked menu and footer only repetition tells."""
    draw, rows = random.Random(3), []
    menu = [f"<div>{sentence(draw, 9)}</div>" for _ in range(3)]
    end = f"<div>{sentence(draw, 12)}</div>"
    for i in range(40):
        body = "".join(f"<p>{sentence(draw, 25)} {i}</p>" for _ in range(3))
        rows.append((i, f"http://site.example/{i}", f"<body>{menu[i % 3]}{body}{end}</body>", body))
    rows.append((100, "http://other.example/", f"<body>{menu[0]}<p>alone</p></body>", None))
    rows.append((100, "http://other.example/", f"<body>{menu[0]}<p>alone</p></body>", None))
    rows.append((101, None, "<p>no url</p>", "<p>no url</p>"))
    rows.append((102, "http://[broken", None, ""))
    rows.append((None, "", "", ""))
    return rows


@pytest.mark.parametrize("words", [1 << 20, 300])
def test_repeated_runs_of_a_host_go(spark, monkeypatch, words):
    monkeypatch.setattr(pages, "SHARD_WORDS", words)
    rows = site_rows()
    table = spark.createDataFrame(
        [(*r[:3], "x", "y") for r in rows], "page_id long, url string, html string, host string, main string"
    )
    got = pages.main_text(table.repartition(4)).collect()
    assert len(got) == len(rows)
    found = {r.key: r.text for r in got}
    for key, _, _, body in rows[:40]:
        assert found[key] == " ".join(body.replace("<p>", " ").replace("</p>", " ").split())
    assert found[100].endswith("alone") and len(found[100].split()) == 10
    assert found[101] == "no url" and found[102] == "" and found[None] == ""
    assert all(r.repeated_blocks == 2 for r in got if r.key is not None and r.key < 40)


def test_article_words_stay_however_often_repeated(spark):
    rows = [(i, "http://h.example/", f"<nav>one two three four five six seven</nav><article>same line for all of us here {i}</article>") for i in range(30)]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"same line for all of us here {i}" for i in range(30)}
    assert all(r.repeated_blocks == 1 for r in got)
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_of_a_page_are_dropped_before_shards_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(pages, "SHARD_WORDS", 200)
    seen = []
    plain = pages.store

    def watched(df, *args, **sizes):
        table = plain(df, *args, **sizes)
        if "shards" in df.columns:
            seen.append({r.host: (r.pages, r.shards) for r in table.df.collect()})
        return table

    monkeypatch.setattr(pages, "store", watched)
    draw = random.Random(5)
    error = f"<body><div>{sentence(draw, 30)}</div></body>"
    rows = [(i, "http://h.example/", error) for i in range(60)]
    rows += [(100 + i, "http://h.example/", f"<p>{sentence(draw, 20)} {i}</p>") for i in range(20)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = {r.key: r.text for r in pages.main_text(table).collect()}
    assert seen == [{"h.example": (21, 3)}]
    assert len(found) == 80 and len({found[i] for i in range(60)}) == 1 and len(found[0].split()) == 30


@pytest.mark.parametrize("words", [1 << 20, 3000])
def test_runs_go_from_within_a_block_and_in_sections_of_a_large_host(spark, monkeypatch, words):
    """A footer on 5 of 400 pages; all of a page is one block, more than half of it repeated."""
    monkeypatch.setattr(pages, "SHARD_WORDS", words)
    draw, rows, own = random.Random(8), [], {}
    ends = [sentence(draw, 40) for _ in range(80)]
    for i in range(400):
        first, last = f"{sentence(draw, 20)} {i}", f"{i} {sentence(draw, 9)}"
        own[i] = f"{first} {last}"
        rows.append((i, f"http://h.example/{i}", f"<body>{first}<br>{ends[i % 80]}<br>{last}</body>"))
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r.key: r.text for r in pages.main_text(table).collect()} == own


@pytest.mark.parametrize("words", [1 << 20, 200])
def test_runs_of_a_host_decide_blocks_of_articles(spark, monkeypatch, words):
    monkeypatch.setattr(pages, "SHARD_WORDS", words)
    draw, rows, own = random.Random(9), [], {}
    notice, quote = sentence(draw, 12), sentence(draw, 12)
    share = "".join(f"<li>{x}</li>" for x in "Share Mail Print Copy Save Link Post".split())
    for i in range(20):
        first, last = f"{sentence(draw, 25)} {i}", f"{i} {quote} {sentence(draw, 9)}"
        own[i] = f"{first} {last}"
        tag = "article" if i % 2 else "main"
        body = f"<p>{first}</p><div>{notice}</div><p>{last}</p><ul>{share}</ul>"
        rows.append((i, f"http://h.example/{i}", f"<nav>Home {i}</nav><{tag}>{body}</{tag}>"))
    base = [sentence(draw, 30) for _ in range(4)]
    for i in range(4):  # near copies, one paragraph edited
        own[100 + i] = " ".join([*base, f"edit {i}"])
        body = "".join(f"<p>{x}</p>" for x in [*base, f"edit {i}"])
        rows.append((100 + i, "http://h.example/", f"<article>{body}</article>"))
    for i in range(4):  # one article under several menus is one
        own[200 + i] = "only once written here for all"
        rows.append((200 + i, "http://h.example/", f"<nav>{i}</nav><article><p>only once written here for all</article>"))
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = pages.main_text(table).collect()
    assert {r.key: r.text for r in got} == own
    assert all(r.repeated_blocks == 8 for r in got if r.key < 20)


def plain_common_blocks(articles):
    """Per article the blocks that stay, by counting whole-block runs of six words in plain Python."""

    def runs(blocks):
        for i in range(len(blocks)):
            words = 0
            for j in range(i, len(blocks)):
                words += len(blocks[j].split())
                if words >= pages.RUN:
                    yield i, j + 1
                    break

    distinct = set(articles)
    count = Counter(run for a in distinct for run in {a[i:j] for i, j in runs(a)})
    least = max(pages.LEAST_ARTICLES, math.ceil(pages.ARTICLE_SHARE * len(distinct)))
    kept = []
    for a in articles:
        gone = {k for i, j in runs(a) if count[a[i:j]] >= least for k in range(i, j)}
        kept.append(" ".join(x for k, x in enumerate(a) if k not in gone))
    return kept


@pytest.mark.parametrize("words", [1 << 20, 500])
def test_common_prose_of_articles_stays(spark, monkeypatch, words):
    """Sentences that many articles share are prose; blocks that most articles have are not."""
    monkeypatch.setattr(pages, "SHARD_WORDS", words)
    draw = random.Random(12)
    common = [sentence(draw, 11) for _ in range(6)]
    notice, steps = sentence(draw, 14), ("Read more", "Send it", "Print this page", "Go up")
    articles = []
    for i in range(60):
        own = [f"{sentence(draw, 30)} {i}", draw.choice(common), f"{draw.choice(common)} {sentence(draw, 5)}", "Short line"]
        draw.shuffle(own)
        if i % 5:
            own.insert(draw.randrange(len(own)), notice)
        articles.append((*own, *(steps if i % 3 else steps[:2])))
    articles.append(articles[0])
    rows = [
        (i, "http://h.example/", "<nav>Home</nav><article>" + "".join(f"<p>{x}</p>" for x in a) + "</article>")
        for i, a in enumerate(articles)
    ]
    few = [(1000 + i, "http://few.example/", f"<article><p>{notice}</p><p>own {i}</p></article>") for i in range(8)]
    table = spark.createDataFrame(rows + few, "page_id long, url string, html string").repartition(4)
    found = {r.key: r.text for r in pages.main_text(table).collect()}
    expected = plain_common_blocks(articles)
    assert [found[i] for i in range(len(articles))] == expected
    assert any(x in t for x in common for t in expected) and not any(notice in t for t in expected)
    assert all(found[1000 + i] == f"{notice} own {i}" for i in range(8))


def test_a_very_long_page(spark):
    draw = random.Random(1)
    body = "".join(f"<p>{sentence(draw, 40)}</p>" for _ in range(3000))
    rows = [(i, "http://h.example/", f"<article>{body}</article>") for i in range(2)]
    found = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = " ".join(body.replace("<p>", " ").replace("</p>", " ").split())
    assert [r.text for r in found] == [text, text]
