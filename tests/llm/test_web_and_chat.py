"""Main texts, URL lists and quotations on hand-made cases."""

import datetime
import math
import random

import pytest

from abacist.llm import main_text, quotations, url_lists

LONG = "long text " * 30
CASES = [
    (None, ""), ("", ""), ("<p>only", "only"), ("no tags &lt;at all&gt;", "no tags <at all>"),
    ("<div><script>var a='<p>x</p>'</script></div>", ""), ("<!-- open <p>hi</p>", ""),
    ("<article><header><h1>Tt</h1></header><p>a<p>b&nbsp; c<ul><li>d</li></ul><footer>f</footer></article><div class=sidebar>zz</div>", "Tt\na\nb c\nd"),
    ("<table><tr><td>a</td><td>b c</td></tr></table>", "a\nb c"),
    (f"<body><div class='cookie-notice'>We use cookies {LONG}</div><div id=content><h1>T</h1><p>Hi &amp; <b>wor</b>ld<br>x</p><p>{LONG}</p>"
     f"<div class=comments><p>{LONG}</p></div><form><label>N</label></form><aside>s</aside></div><div class=sidebar>{LONG}</div></body>",
     f"T\nHi & world x\n{LONG.strip()}"),
    (f"<html><body class='has-sidebar'><nav><ul><li><a href='/a'>a</a></li></ul></nav><main class='page comments-open'><p>{LONG}</p><p>short.</p>"
     "<div class='ad'>Buy</div></main><footer>f</footer></body></html>", f"{LONG.strip()}\nshort."),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_main_text(html, text):
    assert main_text.main_text(html) == text


SMALL = "small text " * 8
WHOLE_PAGES = [
    (f"<body><nav>n</nav><div><section><p>{LONG * 4}</p></section><section><p>{SMALL}</p><p>{SMALL}</p></section></div></body>", f"{LONG * 4}\n{SMALL}\n{SMALL}"),
    (f"<body><h1>Title</h1><p>Lead.</p><div><p>{LONG}</p><p>{LONG}</p>{'<p>end.</p>' * 4}</div><div><a href=x>a</a></div></body>", "\n".join(["Title", "Lead.", LONG, LONG, *["end."] * 4])),
    (f"<body><div><article><p>{LONG * 2}</p></article><article><p>{LONG}</p></article></div><p>out</p></body>", f"{LONG * 2}\n{LONG}\nout"),
    (f"<div class=content><h1>The title</h1><p>Lead by someone.</p><article>{LONG}</article></div>", f"The title\nLead by someone.\n{LONG}"),
    (f"<article>{LONG}</article><div class=part>SECOND {LONG}</div>", f"{LONG}\nSECOND {LONG}"),
    (f"<div id=w><section>{LONG}</section><section><h2>End</h2><p>Short end.</p></section></div>", f"{LONG}\nEnd\nShort end."),
    (f"<form id=aspnetForm><div>{LONG}</div><div class=menu>m</div></form>", LONG),
    (f"<header class=entry-header><h1>Title</h1></header><div class=entry-content>{LONG}</div><header>site</header>", f"Title\n{LONG}"),
    (f"<div class=menu-recipes>{LONG}</div><div class=promo-code-guide>{LONG}</div><div class='sidebar-left'>{LONG}</div>", f"{LONG}\n{LONG}"),
    (f"<div><div><p>{LONG}</p><p>{LONG}</p></div></div><div><ul><li><a href=1>one</a><li><a href=2>two {LONG}</a></ul></div><p><a href=3>up</a>", f"{LONG}\n{LONG}"),
    (f"<div class=text><p>{LONG}</p></div><div class=text><p>end</p></div><div class=other>imprint</div>", f"{LONG}\nend"),
    (f"<article><p>{LONG}</p></article><div class=comments>{LONG * 9}</div>", LONG),
    (f"<body><div class=x><p>{LONG}</div><div class=teaser><p>one</p><p>two</p></div>", LONG),
    (f"<body><div class=x><p>{LONG}</div><div class=y>{'<p>a</p>' * 5}</div>", LONG),
    (f"<div><div class=x><p>{LONG}<p>{LONG}</div></div><div class=z>{'<p>Copyright</p>' * 4}</div>", f"{LONG}\n{LONG}"),
    (f"<body><div><p>{LONG}</p><div class=social-history><p>{LONG}</p></div><div id=share-prices><p>{LONG}</p></div><div class=related-work><p>{LONG}</p></div>"
     f"<div class=share-buttons>{LONG}</div><div class=related>{LONG}</div><div class=post-comments>{LONG}</div></div></body>", "\n".join([LONG] * 4)),
]


@pytest.mark.parametrize(("html", "text"), WHOLE_PAGES)
def test_whole_region(html, text):
    assert main_text.main_text(html) == "\n".join(line.strip() for line in text.strip().split("\n"))


def test_clusters_decide(monkeypatch):
    """Where the cut between the clusters lies changes what is taken on at least one page in five."""
    pages = [h for h, _ in CASES + WHOLE_PAGES]
    real = [main_text.main_text(h) for h in pages]
    changed = set()
    for cut in (-1.0, 1e12):
        monkeypatch.setattr(main_text, "threshold", lambda values, cut=cut: cut)
        changed |= {i for i, h in enumerate(pages) if main_text.main_text(h) != real[i]}
    assert 5 * len(changed) >= len(pages), len(changed)


def plain_clusters(values, sigma=main_text.SIGMA):
    """Ratios smoothed and cut, position by position: the best of all cuts into two clusters that 2-means can end in."""
    smooth = []
    for i in range(len(values)):
        weights = {j: math.exp(-(i - j) ** 2 / (2 * sigma**2)) for j in range(len(values)) if abs(i - j) <= math.ceil(3 * sigma)}
        smooth.append(sum(weights[j] * values[j] for j in weights) / sum(weights.values()))
    return smooth


def test_smoothing_and_clusters_are_those_of_plain_loops():
    rng = random.Random(1)
    for _ in range(200):
        values = [rng.choice([rng.uniform(0, 5), rng.uniform(0, 200)]) for _ in range(rng.randint(1, 40))]
        smooth = main_text.smoothed(values)
        assert smooth == pytest.approx(plain_clusters(values))
        cut = main_text.threshold(smooth)
        lower, upper = [v for v in smooth if v <= cut], [v for v in smooth if v > cut]
        assert upper
        if lower:  # a fixed point: every value is nearer to its own centre, and the centres are apart
            low, high = sum(lower) / len(lower), sum(upper) / len(upper)
            assert 2 * low < high and all(abs(v - low) <= abs(v - high) + 1e-9 for v in lower) and all(abs(v - high) <= abs(v - low) + 1e-9 for v in upper)


def test_pages(spark):
    pages = spark.createDataFrame([(i, "u", h, "x") for i, (h, _) in enumerate(CASES)] + [(None, None, "<p>a", "x")],
                                  "page_id long, url string, html string, text string")
    rows = main_text.extract(pages).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in rows} == {**{i: (t, len(t)) for i, (_, t) in enumerate(CASES)}, None: ("a", 1)}
    assert main_text.extract(pages.where("false")).collect() == []


def test_deep_and_long_pages():
    assert main_text.main_text("<div>" * 5000 + "<p>" + "word " * 100_000 + "</b>" * 5000) == ("word " * 100_000).strip()


DAY = datetime.date
ENTRIES = [("domain", "bad.org", "block", DAY(2024, 1, 10)), ("domain", "bad.org", "remove", DAY(2024, 2, 1)),
           ("domain", "good.bad.org", "allow", DAY(2024, 1, 15)), ("path", "site.com/a/b", "block", DAY(2024, 1, 1)),
           ("path", "site.com/a/b", "allow", DAY(2024, 1, 1)), ("url", "http://site.com/a/b/c?x=1", "allow", DAY(2024, 1, 5)),
           (None, "x", "block", DAY(2024, 1, 1)), ("domain", None, "block", DAY(2024, 1, 1)), ("domain", "x.y", "block", None),
           ("domain", "x.y", "other", DAY(2024, 1, 1))]
CAPTURES = [("http://bad.org/", DAY(2024, 1, 9), None), ("http://bad.org/", DAY(2024, 1, 10), "block"), ("https://www.bad.org:80/p", DAY(2024, 1, 31), "block"),
            ("http://bad.org/", DAY(2024, 2, 1), None), ("http://u@GOOD.bad.org/", DAY(2024, 1, 14), "block"), ("http://good.bad.org/", DAY(2024, 1, 15), "allow"),
            ("http://good.bad.org/", DAY(2024, 3, 15), "allow"), ("http://notbad.org/", DAY(2024, 1, 15), None),
            ("http://site.com/a/b/c?x=1", DAY(2024, 1, 4), "block"), ("http://site.com/a/b/c?x=1", DAY(2024, 1, 5), "allow"),
            ("http://site.com/a/bb", DAY(2024, 1, 5), None), ("http://site.com//a/b/", DAY(2024, 1, 5), "block"), ("http://x.y/", DAY(2024, 1, 5), None),
            (None, DAY(2024, 1, 5), None), ("http://bad.org/", None, None), ("no url", DAY(2024, 1, 15), None), ("", DAY(2024, 1, 15), None)]


def test_url_lists(spark):
    entries = spark.createDataFrame(ENTRIES, "kind string, key string, action string, day date")
    captures = spark.createDataFrame([(i, *c, "clash") for i, c in enumerate(CAPTURES * 2)],
                                     "id long, url string, day date, want string, listed string")
    rows = url_lists.listed(captures, entries).collect()
    assert len(rows) == 2 * len(CAPTURES)
    for row in rows:
        assert (row._listed.action, row._listed.blocked) == (row.want, row.want == "block"), row
    assert url_lists.listed(captures.where("false"), entries).collect() == []
    assert {r._listed.blocked for r in url_lists.listed(captures, entries.where("false")).collect()} == {False}


def test_quotations(spark):
    rows = [(1, 0, "First line.\nSecond line of it."), (1, 1, "> first  LINE.\nAgreed."), (1, 2, "Ann wrote:\n> Agreed.\n>> First line.\nAnd more."),
            (1, 3, "> never said\nOdd."), (1, 4, "> > Agreed.\n> And more.\n\n\n\nEnd"), (1, 5, None), (1, 5, "> End\ntwice"), (2, 0, "> Agreed.\nOther place."),
            (None, 0, "> x"), (2, None, "> Other place.\ny"), (2, 1, ">\n> \n"), (2, 2, "Agreed.\n> Other place."), (2, 3, "> Agreed.")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, text string, reply string")
    got = {(r.conv_id, r.turn, r.text): tuple(r._reply) for r in quotations.linked(frame).collect()}
    want = [("First line.\nSecond line of it.", None, 0, 0), ("Agreed.", 0, 0, 1), ("And more.", 1, 0, 2), ("Odd.", None, 3, 0), ("End", 2, 0, 3),
            ("", 4, 0, 4), ("twice", 4, 0, 4), ("Other place.", None, 0, 0), ("", None, 0, 0), ("y", None, None, 0), ("", None, 1, 0),
            ("Agreed.", 0, 0, 1), ("", 2, 0, 2)]
    assert got == {r: w for r, w in zip(rows, want)}
    assert quotations.linked(frame.where("false")).collect() == []


def test_nested_quotations(spark):
    rows = [(1, 0, "First line."), (1, 1, "Second."), (1, 2, "Ann wrote:\n>> First line.\nNested only."), (1, 3, ">> First line.\n> Second.\nBoth."),
            (1, 4, ">> First line.\n> never said\nOuter unknown."), (1, 5, ">>> First line.\n>> Second.\nLowest.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = {r.turn: (r.reply.own_text, r.reply.reply_to, r.reply.depth) for r in quotations.linked(frame).collect()}
    assert got == {0: ("First line.", None, 0), 1: ("Second.", None, 0), 2: ("Nested only.", 0, 1), 3: ("Both.", 1, 1),
                   4: ("Outer unknown.", 0, 1), 5: ("Lowest.", 1, 1)}
    found = {(r.turn, r.level, r.source) for r in quotations.sources(frame).collect()}
    assert found == {(2, 2, 0), (3, 2, 0), (3, 1, 1), (4, 2, 0), (5, 3, 0), (5, 2, 1)}
