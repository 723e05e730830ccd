"""Main text of pages; exact search."""

import random
import time

import duckdb
import numpy as np
import pytest

from feedback_engine.llm import html, topk


def page(body):
    return f'<!DOCTYPE html><html><head><title>T</title><script>var x="</p>";</script></head><body><nav><ul><li><a href="/a">The menu of it</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy the best of the best and more.</div>{body}<footer>&copy; the owner of it</footer></body></html>'


def test_article():
    got = html.main_text(page("<article><h1>Head &amp; line</h1><p><b>First the text<br><p>Short.</p><p>The  second\n part of it.</p></article>"))
    assert got == "Head & line First the text Short. The second part of it."


def test_without_an_article():
    long = "The story of the man and the sea is that he went to it and was with it for all the days of his life. " * 3
    got = html.main_text(page(f'<div><p>{long}</p><p>And so on.</p><p>{long}</p></div><div id="comments"><p>{long}</p></div><aside>{long}</aside><form><p>{long}</p></form><ul><li><a href="/x">{long}</a></li></ul>'))
    assert got == " ".join([long.strip(), "And so on.", long.strip()])


def test_language_without_stop_words():
    middle = "Suomenkielinen kappale kertoo kaupungista, jossa asukkaat rakentavat uusia taloja ja puistoja."
    linked = f'<div><a href="/x">{middle}</a></div>'
    assert html.main_text(page(f"<div><p>{middle}</p><p>{middle * 3}</p></div>{linked}<aside>{middle}</aside>")) == f"{middle} {middle * 3}"


def test_marks():
    long = "The story of the man and the sea is that he went to it and was with it for all the days of his life. " * 3
    body = f'<div class="layout has-sidebar"><header class="top"><h1>Site</h1></header><div class="sidebar">{long}</div><article><header class="entry-header"><h1>Title of it</h1></header><p>{long}</p><figure><figcaption>A caption.</figcaption></figure><p>See <a href="/s">the source of it</a>.</p><ul><li><a href="/r">Related thing</a></li></ul><div class="share-buttons">Share it</div></article><article class="comment"><p>{long}</p></article><div style="display: none">{long}</div></div>'
    assert html.main_text(page(body)) == " ".join(["Title of it", long.strip(), "A caption.", "See the source of it."])


@pytest.mark.parametrize("name", ["button", "svg", "math", "select", "object", "template"])
def test_unclosed_element_without_text(name):
    long = "It was the text of the page and there is more of it. " * 5
    for later in ("", f"<p>Then <{name}>no</{name}>some.</p>" if name != "template" else ""):
        got = html.main_text(page(f"<article><p>{long}<{name} class='x'>no</p><p>{long}</p>{later}</article>"))
        assert got == " ".join([long.strip(), long.strip(), *["Then some."] * bool(later)])
    assert html.main_text(f"<article><p>{long}</p><script>no <p>{long}") == long.strip()
    assert html.main_text(f"<article><p>{long}<svg><svg>no</svg>no</svg>{long}</p>") == long + long.strip()


PROSE = "The story of the man and the sea is that he went to it and was with it for all the days of his life. " * 3


def test_attributes_and_marks_of_doubt():
    assert html.main_text("<article><p title=it's>The man's story</p><p title=\"open>and <b>of it</b></p></article>") == "The man's story and of it"
    assert html.main_text(page(f"<main><div class='ad-free'><p>{PROSE}</p></div><div class=text-widget><p>{PROSE}</p><p>Follow us</p></div></main>")) == f"{PROSE.strip()} {PROSE.strip()}"
    assert html.main_text(page(f'<article class="related"><p>{PROSE}</p></article>')) == PROSE.strip()
    assert html.main_text(page(f'<article class="related"><p>{PROSE}</p></article><article><p>It is the one. {PROSE}</p></article>')) == f"It is the one. {PROSE.strip()}"


def test_density_and_neighbours_decide_in_articles():
    links = "<ul>" + "".join(f'<li><a href="/{i}">Other page {i}</a></li>' for i in range(5)) + "</ul>"
    names = "Zorp blat quib frond. " * 20
    got = html.main_text(page(f"<article><h1>Zorp</h1><p>{PROSE}</p><p>Quib.</p>{links}<h2>Blat</h2><p>{names}</p><p>{PROSE}</p></article>"))
    assert got == " ".join(["Zorp", PROSE.strip(), "Quib.", "Blat", names.strip(), PROSE.strip()])
    assert html.main_text(page(f"<article><p>{names}</p></article>")) == names.strip()


def plain_labels(found):
    """The rules once more, block by block, as they are told."""
    stop = [[w in html.STOP_WORDS for w in html.WORD.findall(b.text.lower())] for b in found]
    open_ = [x for x, b in zip(stop, found) if b.around != html.HARD]
    foreign = sum(map(sum, open_)) < 0.12 * sum(map(len, open_))

    def alone(b, x):
        d, n = sum(x) / max(len(x), 1), len(b.text)
        if b.around == html.HARD or not b.article and b.linked > 0.33 * n:
            return False
        if b.article and b.tag == "li" and b.linked > 0.8 * n and (n < 200 or d < 0.22):
            return False
        if n >= 200 and d >= 0.12 or n >= (200 if b.around == html.FAINT else 70) and (d >= 0.22 or foreign and (b.article or n >= 200)):
            return True
        return False if b.around == html.FAINT or n >= 70 and d < 0.12 and not foreign and not b.article else None

    first = [alone(b, x) for b, x in zip(found, stop)]
    if any(f and b.around != html.MARKED for f, b in zip(first, found)) or any(b.article and not b.around for b in found) or not any(f and len(b.text) >= 200 for f, b in zip(first, found)):
        first = [False if b.around == html.MARKED else f for f, b in zip(first, found)]
    out = []
    for i, b in enumerate(found):
        same = [j for j in range(len(found)) if found[j].container == b.container and first[j] is not None]
        near = [j for j in (max((j for j in same if j < i), default=None), min((j for j in same if j > i), default=None)) if j is not None]
        if first[i] is not None:
            out.append(first[i])
        elif not near:
            out.append(b.article or not any(first) and not any(x.article for x in found))
        elif b.tag in html.HEADINGS and near[-1] > i:
            out.append(first[near[-1]])
        elif b.article or len({first[j] for j in near}) == 1:
            out.append(any(first[j] for j in near))
        else:
            out.append(first[min(near, key=lambda j: (abs(j - i), j))])
    return out


def test_labels_against_the_rules():
    rng = random.Random(5)
    words = ["the", "of", "and", "zorp", "blat", "quib", "frond", "skell"]
    tags = ["p", "li", "h2", "div", "div class=widget", "div class=comments", "aside", "article", "section"]
    for _ in range(400):
        body, open_ = [], []
        for _ in range(rng.randint(1, 25)):
            t = rng.choice(tags)
            text = " ".join(rng.choice(words[rng.choice([0, 0, 3]) :]) for _ in range(rng.choice([2, 5, 12, 16, 40, 60])))
            body.append(f"<{t}>" + (f"<a href=x>{text}</a>" if rng.random() < 0.2 else text))
            if rng.random() < 0.6:
                body.append(f"</{t.split()[0]}>")
        found = html.blocks("".join(body))
        assert html.classify(found) == plain_labels(found)


@pytest.mark.parametrize("part", ['<b title="x', "<b title='", "<template>", "<p>a<button>", "<!--", "<article><b></html>", "<p title=it's>hello", "<", "<a", "</", "<a b=", "&#"])
def test_hostile_pages_take_linear_time(part):
    began = time.perf_counter()
    html.main_text("<html><article>" + part * 20_000)
    assert time.perf_counter() - began < 5


def test_columns_with_odd_names_and_large_ids(spark):
    df = spark.createDataFrame([(2**60 + 1, "u", "<p>the text of it", 5), (None, "v", None, None)], "page_id long, url string, html string, `a.b` long")
    got = sorted(html.extract(df).collect(), key=lambda r: r["url"])
    assert [tuple(r) for r in got] == [(2**60 + 1, "u", 5, "the text of it", 14), (None, "v", None, "", 0)]


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>unclosed <b>the text"), (4, "u", "no markup at all"), (4, "u", "no markup at all"), (5, "u", "<<<>>&bogus; &#x41;&#66; <p"), (None, "u", "<script>only"), (6, "u", page("<article></article>"))]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = html.extract(df).collect()
    assert len(got) == len(rows) and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (1, 2, 6)] == ["", "", ""]
    assert html.extract(df.limit(0)).count() == 0


def test_very_long_page():
    body = "".join(f"<p>The paragraph {i} of the article is in it for the reader.</p>" for i in range(20000))
    assert len(html.main_text(page(f"<article>{body}</article>"))) > 1_000_000


def brute(rows, k, every):
    v = [(i, [int(np.floor(256 * float(x))) for x in e]) for i, e in rows]
    out = []
    for a, (q, x) in enumerate(v):
        if q % every == 0:
            best = sorted((-sum(s * t for s, t in zip(x, y, strict=True)), c) for b, (c, y) in enumerate(v) if a != b and len(x) == len(y))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def test_search_against_brute_force(spark, folder):
    rng = random.Random(9)
    good = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(400)]
    good = [(i, list(good[7][1]) if 100 <= i < 140 else v) for i, v in good]
    # Repeated ids: an exact copy, many copies of a best one, another vector under the same id.
    good += [good[50], (100, [0.9] * 12), (150, [1.5] * 12), (200, [2.0] * 12), *[(333, [3.0] * 12)] * 9, *[(350, [2.5] * 12)] * 3]
    bad = [(900, None), (950, [0.1, None] * 6), (1000, [float("nan")] * 12), (1050, [float("inf")] + [0.0] * 11), (None, [0.5] * 12)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>")
    d = folder(embeddings=df)
    assert sorted(map(tuple, topk.op9_exact_top_k(spark, d).collect())) == brute([(i, np.float32(v)) for i, v in good], 5, 50)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet/*.parquet')")
    assert sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.OP9_SQL})").fetchall()) == brute([(i, np.float32(v)) for i, v in good], 5, 50)
    rows_ = df.select(df["vec_id"].alias("id"), topk.quantised(df["embedding"]).alias("vec")).filter("id is not null and vec is not null")
    small = topk.exact_top_k(rows_.filter("id % 50 = 0"), rows_, k=9, width=5, candidate_rows=64, query_rows=3)
    assert sorted(map(tuple, small.collect())) == brute([(i, np.float32(v)) for i, v in good], 9, 50)


def test_few_rows(spark, folder):
    d = folder(embeddings=spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [])], "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, topk.op9_exact_top_k(spark, d).collect())) == [(0, 1, 1, 256 * 512)]
    d = folder(embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.op9_exact_top_k(spark, d).count() == 0


@pytest.mark.parametrize("token", ["share-price", "related-work", "notice-period", "menu_engineering", "ad-hoc", "cookie-recipes", "banner-bearers", "related", "share", "promo-section"])
def test_marks_do_not_overrule_dense_prose(token):
    """In an article a part stays if it holds prose, also what is short in it; without prose it goes."""
    part = f'<section class="{token}"><h2>On it</h2><p>Of the one. {PROSE}</p><p>In short.</p><p>Of the other. {PROSE}</p></section>'
    got = html.main_text(page(f"<article><p>{PROSE}</p>{part}<p>And so it was. {PROSE}</p></article>"))
    assert got == " ".join([PROSE.strip(), "On it", f"Of the one. {PROSE.strip()}", "In short.", f"Of the other. {PROSE.strip()}", f"And so it was. {PROSE.strip()}"])
    got = html.main_text(page(f'<article><p>{PROSE}</p><div class="{token}"><p>Share it</p><p><a href="/x">The other of the two</a></p></div><p>And so it was. {PROSE}</p></article>'))
    assert got == f"{PROSE.strip()} And so it was. {PROSE.strip()}"


@pytest.mark.parametrize("token", ["comment-thread", "comments", "comment_list", "ad-slot", "ads", "advert-box", "sidebar-left", "sidebar", "cookie-banner", "nav-menu", "footer-content", "notice", "sponsored-content", "disqus_thread"])
def test_containers_of_no_main_text_go_whole(token):
    got = html.main_text(page(f'<article><p>{PROSE}</p><div class="{token}"><p>Of the one. {PROSE}</p><p>Of the other. {PROSE}</p></div><p>And so it was. {PROSE}</p></article>'))
    assert got == f"{PROSE.strip()} And so it was. {PROSE.strip()}"


def test_unmarked_notices():
    for notice in ("This site uses cookies. Accept all.", "We use cookies to improve the site. Do you agree?", "Wir verwenden Cookies. Alle akzeptieren", "Utilizamos cookies. Aceptar"):
        assert html.main_text(page(f"<article><div><p>{notice}</p></div><p>{PROSE}</p></article>")) == PROSE.strip()
    tale = "She would not accept cookies from the man by the sea."
    assert html.main_text(page(f"<article><p>{tale}</p><p>{PROSE}</p></article>")) == f"{tale} {PROSE.strip()}"
    long = f"The site of the man has cookies in it and he can accept them. {PROSE}"
    assert html.main_text(page(f"<article><p>{long}</p></article>")) == long.strip()
