"""Main text and URL rules of pages."""

import html
import re

import pytest

from textscore.llm import html_text, queries, url_rules
from textscore.llm.common import table

SMALL = "/root/testdata/sf0.001"


def plain(source):
    """The article of the given pages, by its own tags."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    sources = {r.page_id: r.html for r in table(spark, SMALL, "pages").collect()}
    found = queries.op6_html_text(spark, SMALL).collect()
    assert {r.page_id: r.text for r in found} == {i: plain(s) for i, s in sources.items()}
    assert all(r.n_chars == len(r.text) for r in found)


def test_pages_without_marked_articles(spark):
    # weights learned from marked pages hold for others
    pages = table(spark, SMALL, "pages")
    weights = html_text.learn(pages)
    rows = pages.where("length(html) > 1500").collect()
    same = sum(html_text.main_text(re.sub(r"</?article>", "", r.html), weights) == plain(r.html) for r in rows)
    assert same > 0.9 * len(rows)


ARTICLE = "<h1>Title &amp; more</h1><p>First   paragraph with <a href='x'>a link</a>,<br>and a <b>bold</b> end.<p>Second one, unclosed &lt;tag&gt;"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("only words", "only words"), ("<!-- c", ""), ("a < b", "a < b"), ("<p>cut <b", "cut"),
        (f"<article>{ARTICLE}</article>", "Title & more\nFirst paragraph with a link, and a bold end.\nSecond one, unclosed <tag>"),
        (f"<nav><ul><li>Home<li>About us</ul></nav><main>{ARTICLE}</main><footer>Some words in a footer, quite a few of them here.</footer>", "Title & more\nFirst paragraph with a link, and a bold end.\nSecond one, unclosed <tag>"),
        ("<div class='cookie-notice'><p>We use cookies on this page</p></div><article><p>One two three four five six</p><div class=ad>Buy now</div><script>var t='</p>';</script><form><p>Search words</p></form><p>seven eight nine ten eleven twelve thirteen</p></article><section id='comments'><p>Nice post</p></section>", "One two three four five six\nseven eight nine ten eleven twelve thirteen"),
        ("<header><h1>Site name</h1></header><article><header><h1>Title</h1></header><p>Text of it all</p></article>", "Title\nText of it all"),
        ("<table><tr><td>one<td>two<tr><td>three</table>", "one\ntwo\nthree"),
        ("<p hidden>not this</p><p>but this</p>", "but this"),
    ],
)
def test_main_text(source, text):
    assert html_text.main_text(source, html_text.Weights({})) == text


TEN = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize("cut", ["<div class='share'>Tell all your friends</div>", "<aside>More of it</aside>", "<script>x</script><div class=ad>Buy now</div>"])
def test_left_out_elements_do_not_part_an_article(spark, cut):
    strong = html_text.Weights({(html_text.OUT, n): -10.0 for n in ("div", "aside", "script")} | {(html_text.WORD, b): 0.7 for b in ("p", "h1")} | {(html_text.TAG, n): -0.05 for n in ("p", "/p", "h1", "/h1")})
    source = f"<h1>Short</h1>{cut}<p>{TEN} {TEN}</p>{cut}<p>{TEN}</p>"
    want = f"Short\n{TEN} {TEN}\n{TEN}"
    assert html_text.main_text(f"<nav>Menu</nav><article>{source}</article>{cut}", strong) == want
    # where labelled articles hold such elements, they part nothing on other pages either
    menu = "<nav>Home</nav><div>Menu words</div>"
    rows = [(i, f"{menu}<article>{source}</article><footer>Foot {i}</footer>") for i in range(40)]
    learned = html_text.learn(spark.createDataFrame(rows, "page_id long, html string"))
    assert learned.of((html_text.OUT, "nav")) < -2
    assert html_text.main_text(f"{menu}<section>{source}</section><footer>Foot</footer>", learned) == want


@pytest.mark.parametrize(
    "wrapper",
    ["<div class='layout with-sidebar'>", "<div id='content' class='post has-comments'>", "<section class='ad-free'>", "<form action=x>", "<div class='flex hidden md:block'>", "<div class='page-widget'>", "<div data-class='ad'>", "<div class=sidebar>"],
)
def test_marked_wrappers_of_the_article(wrapper):
    name = re.match(r"<(\w+)", wrapper)[1]
    for inner in (f"<article><p>{TEN}</p><p>{TEN}</p></article>", f"<p>{TEN}</p><p>{TEN}</p>"):
        for menu in ("", "<nav>Home</nav>"):
            assert html_text.main_text(f"{menu}{wrapper}{inner}</{name}>", html_text.Weights({})) == f"{TEN}\n{TEN}"


def test_small_marked_elements_stay_out():
    for out in ("<div class='ad-slot'>Buy now</div>", "<div class=comments><article>Nice post</article></div>", "<form>Search</form>", "<div style='display: none'>no</div>", "<p aria-hidden=true>no</p>"):
        assert html_text.main_text(f"<article><p>{TEN}</p>{out}<p>{TEN}</p></article>", html_text.Weights({})) == f"{TEN}\n{TEN}"
    assert html_text.main_text(f"<article><p>{TEN}</p><section class='ad-free'><p>{TEN}</p></section><p>{TEN}</p></article>", html_text.Weights({})) == f"{TEN}\n{TEN}\n{TEN}"


def test_best_run():
    assert html_text.best_run([]) == html_text.best_run([-1.0]) == (0, 0)
    assert html_text.best_run([1.0, -2.0, 3.0, -1.0, 2.0, -5.0]) == (2, 5)


def test_very_long_page():
    source = "<nav>" + "<a>x</a>" * 20_000 + "</nav><article>" + "<p>some words here</p>" * 20_000 + "</article>"
    assert html_text.main_text(source, html_text.Weights({})).count("\n") == 19_999


def test_no_labelled_pages_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "<p>a b</p>", "x"), (1, "<p>a b</p>", "x"), (2, None, "x")], "page_id long, html string, text string")
    got = html_text.extract(rows, html_text.learn(rows)).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, "a b"), (1, "a b"), (2, "")]
    assert html_text.learn(rows.limit(0)).learned == {}


URLS = [
    ("http://a.b.example.NET/en/1?x#y", "a.b.example.net", "/en/1", "example.net/en/"),
    ("https://example.net/en", "example.net", "/en", "net/"),
    ("http://notexample.net/en/1", "notexample.net", "/en/1", "net/"),
    ("http://example.com/de/", "example.com", "/de/", "example.com/de/"),
    ("http://badexample.com/de/", "badexample.com", "/de/", None),
    ("x://fr.org/fr/é", "fr.org", "/fr/é", "org/fr/"),
    ("http://net", "net", "", None),
    ("http://ÄA.net/ÄA", "Äa.net", "/ÄA", "net/"),
    ("no scheme/net/", "", "", None), (None, "", "", None), ("", "", "", None), ("://", "", "", None),
    ("http://a?u=http://b.net/", "a", "", None),
]


def test_hosts_paths_and_fixed_rules(spark):
    rows = spark.createDataFrame([(i, u[0], "old") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_rules.judge(rows, queries.URL_RULES).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}


def test_mined_rules_decide_the_rest(spark):
    urls = [f"http://s{i}.example.net/{'en' if i % 2 else 'es'}/{i}" for i in range(60)] + ["http://s.example.com/en/1", "http://s.example.com/es/2", "http://s.example.com/zz/2"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(rows, queries.URL_RULES).collect()}
    assert (got[60], got[61], got[62]) == ("allow", "block", "allow")
    mined = url_rules.mine(rows.where("page_id < 60").selectExpr("url", "if(page_id % 2 = 1, 'allow', 'block') verdict"), "url", "verdict", 0.05, 0.9, 100)
    assert all(r["confidence"] >= 0.9 and r["support"] >= 0.05 for r in mined)
    for a in mined:
        assert not any(b is not a and b["verdict"] == a["verdict"] and set(b["items"]) <= set(a["items"]) for b in mined)


def url_tokens(url):
    """The tokens of a URL in plain Python."""
    scheme, found, rest = url.partition("://")
    if not found:
        return set()
    h, p = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    labels, parts = h.lower().split("."), [re.sub("[0-9]+", "0", x) for x in p.split("/") if x]
    query, mark, ending = re.search(r"\?([^#]*)", url), re.search("#(.*)$", url), re.search(r"(\.[A-Za-z]+|/)$", p)
    out = {f"scheme={scheme.lower()}", f"top={labels[-1]}"} | {f"label={x}" for x in labels} | {f"part={x}" for x in parts}
    out |= {f"under{n}={'.'.join(labels[-n:])}" for n in (2, 3) if len(labels) >= n} | {f"first={x}" for x in parts[:1]}
    out |= {f"key={x.split('=')[0]}" for x in (query[1].split("&") if query else [])}
    out |= {f"mark={mark[1]}"} if mark else set()
    out |= {f"ending={ending[1]}"} if ending else set()
    return {t for t in out if not t.endswith("=")}


def brute_rules(rows, support, confidence):
    """All rules from every combination of the frequent tokens, redundant ones left out."""
    from itertools import combinations

    baskets = [(url_tokens(u), v) for u, v in rows]
    pages = {}
    for i, (own, _) in enumerate(baskets):
        for t in own:
            pages.setdefault(t, set()).add(i)
    first = {}
    for t in sorted(pages):
        if len(pages[t]) >= support * len(rows):
            first.setdefault(frozenset(pages[t]), t)
    known = set(first.values())
    sets = {c for own, _ in baskets for n in range(1, len(own & known) + 1) for c in combinations(sorted(own & known), n)}
    found = []
    for items in sets:
        verdicts = [v for own, v in baskets if set(items) <= own]
        for verdict in set(verdicts):
            n = verdicts.count(verdict)
            if n >= support * len(rows) and n / len(verdicts) >= confidence:
                found.append((-n / len(verdicts), -n / len(rows), len(items), " ".join(items), items, verdict))
    kept = []
    for c, s, _, _, items, verdict in sorted(found):
        if not any(v == verdict and set(k) <= set(items) for k, v, *_ in kept):
            kept.append((items, verdict, pytest.approx(-c), pytest.approx(-s)))
    return kept


def test_mining_equals_every_combination(spark):
    import random

    rng = random.Random(7)
    hosts = ["a.b.net", "x.org", "www.shop.example.com", "deep.er.still.b.net"]
    urls = []
    for _ in range(200):
        parts = [rng.choice(["en", "fr", "casino", "blog", str(rng.randint(1, 99))]) for _ in range(rng.randint(0, 6))]
        keys = "&".join(f"{rng.choice('abc')}=1" for _ in range(rng.randint(0, 4)))
        urls.append(f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}/{'/'.join(parts)}" + (f"?{keys}" if keys else "") + rng.choice(["", "", "#top"]))
    rows = [(u, "block" if ("casino" in u) ^ (rng.random() < 0.05) else "allow") for u in urls] + [("no scheme", "block")]
    frame = spark.createDataFrame(rows, "url string, verdict string")
    mined = url_rules.mine(frame, "url", "verdict", 0.08, 0.8, 10**6)
    want = brute_rules(rows, 0.08, 0.8)
    assert [(tuple(r["items"]), r["verdict"], r["confidence"], r["support"]) for r in mined] == want and len(want) > 10
    assert [r["items"] for r in url_rules.mine(frame, "url", "verdict", 0.08, 0.8, 5)] == [list(w[0]) for w in want[:5]]
    # matching against every rule in turn
    tested = [*urls, "http://a.b.net/x/y/z/w/v/casino/1?q=1&r=2&a=3", "http://nowhere/", "", "no scheme"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(tested)], "id long, url string")
    got = {r.id: r.v for r in pages.select("id", url_rules.mined_verdict(url_rules.F.col("url"), mined).alias("v")).collect()}
    assert got == {i: next((v for items, v, *_ in want if set(items) <= url_tokens(u)), None) for i, u in enumerate(tested)}
    assert got[200] == "block"


def test_every_part_of_a_url_is_a_token(spark):
    url = "http://a.b.c.d.net/x/y/z/casino/17/../e.html?a=1&b=2&c=3&&d#m"
    rows = [url, "http://" + "l." * 3000 + "net/" + "p/" * 5000 + "last?" + "k=1&" * 3000, "x://", None, "none"]
    got = [set(r.t or []) for r in spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "id long, url string").select("id", url_rules.tokens(url_rules.F.col("url")).alias("t")).orderBy("id").collect()]
    assert got == [url_tokens(u or "") for u in rows]
    assert {"part=casino", "part=0", "key=c", "key=d", "label=c"} <= got[0] and "part=last" in got[1]


def test_nothing_to_mine(spark):
    rows = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x")], "page_id long, url string")
    assert [r.verdict for r in url_rules.judge(rows, queries.URL_RULES, default="block").collect()] == ["block", "block"]
    assert url_rules.judge(rows.limit(0), queries.URL_RULES).collect() == []


def test_judging_is_native(spark):
    plan = queries.op8_url_rules(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
