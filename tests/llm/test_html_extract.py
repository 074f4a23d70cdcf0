from feldspark.llm import html_extract as H

W = H.learn()


def test_labelled_pages_are_found():
    for page in H.LABELLED:
        start, end = page.index("[["), page.index("]]")
        inner = "\n".join(" ".join(x.split()) for x in H.extract("<article>" + page[start + 2 : end] + "</article>", W).split("\n"))
        assert H.extract(page.replace("[[", "").replace("]]", ""), W) == inner


def test_signs_of_weights():
    assert W["v"] > 0 and W["w"] > 0
    assert all(v < 0 for k, v in W.items() if k not in ("v", "w", "A"))


def test_best_run_is_the_maximum():
    import random

    rnd = random.Random(0)
    for _ in range(200):
        s = [rnd.choice([-2, -1, 0, 1, 2]) for _ in range(rnd.randrange(0, 12))]
        best = max([sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)], default=0)
        a, b = H.best_run(s)
        assert sum(s[a:b]) == max(best, 0)


def test_boilerplate_goes_and_text_stays():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="home has-sidebar">
    <header><a href=/>Site</a> of news</header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies on this page</div>
    <article><h1>A &amp; B&nbsp;&#39;c&#x27; &lt;d&gt;</h1><div class="ad">Buy this now</div><p>One <b>two</b>  three,
    fo<i>ur</i>.<br>Five<p>Six &amp seven <a href=x>eight</a></p><form><p>Mail?</p><button>Send</button></form><aside>Aside words</aside>
    <ul><li>n1<li>n2</ul><p>End.</p><footer>By someone</footer></article><section id="comments"><div class="comment"><p>I liked it very much indeed and more</p></div></section>
    <footer>&copy; Site</footer>"""
    assert H.extract(page, W) == "A & B 'c' <d>\nOne two three, four. Five\nSix & seven eight\nn1\nn2\nEnd."


def test_odd_pages():
    assert H.extract(None, W) == H.extract("", W) == H.extract("<nav>x</nav>", W) == ""
    assert H.extract("plain words only", W) == "plain words only"
    assert H.extract("<p>a < b and c > d</p>", W) == "a < b and c > d"
    assert H.extract("<p>one</p", W) == "one"
    assert H.extract("<article><p>x y z" + "<b>" * 5000, W) == "x y z"
    assert H.extract("<article>" + "<p>word</p>" * 20000, W).count("\n") == 19999


def test_table(spark):
    rows = [(1, "u", "<p>a b</p>", "keep", "clash"), (1, "u", "<p>a b</p>", "keep", "clash"), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, extra string, text string")
    got = H.extract_pages(df)
    assert got.columns == ["page_id", "url", "extra", "text"]
    assert sorted(r["text"] for r in got.collect()) == ["", "a b", "a b"]
    assert H.extract_pages(df.where("false")).count() == 0


BODY = "<h1>The bridge</h1>" + "<p>The old bridge over the river was built by the monks, who took a toll of one egg from each cart that went over it to the market.</p>" * 6


def text_of(html):
    return H.extract(html, W)


def test_names_are_hints_only():
    want = text_of(f"<article>{BODY}</article>")
    assert want.count("\n") == 6
    for page in (
        f'<article class="social-policy">{BODY}</article>',
        f'<div class="promotion-story">{BODY}</div>',
        f'<body><div class="menu"><a href=1>Home</a></div><div id="notice-board"><div>{BODY}</div></div></body>',
        f'<body><div class="sponsored"><div class="x">{BODY}<div class="ad">Buy now</div></div></div></body>',
        f'<body><main class="widget">{BODY}</main></body>',
    ):
        assert text_of(page) == want, page[:60]


def test_noise_by_its_name_goes_even_if_long():
    want = text_of(f"<article>{BODY}</article>")
    talk = "<p>I was there last year with my sister and we both liked the bridge and the river a lot.</p>" * 10
    for page in (
        f'<article>{BODY}</article><div class="comments">{talk}</div>',
        f'<div>{BODY}<div class="comments">{talk}</div></div>',
        f'<article>{BODY.replace("</h1>", "</h1><div class=advert>Buy eggs today</div>")}</article>',
        f'<article><p>Short.</p></article><div class="cookie-notice">{talk}</div>',
    ):
        assert text_of(page) == (want if "Short." not in page else "Short.")


def test_the_scan_decides_where_names_tell_nothing():
    """Pages whose elements have opaque names; without the scan, all words outside scripts and the like are the text."""
    page = (
        '<body><div class="a1"><a href=1>Home</a> <a href=2>News</a> <a href=3>Towns</a></div><div class="b2"><span>Hello guest</span></div><div class="c3">'
        f'{BODY}</div><div class="d4"><div><a href=4>Bridges</a></div><div><a href=5>Monks</a></div></div><div class="e5">All rights kept</div></body>'
    )
    assert text_of(page) == text_of(f"<article>{BODY}</article>")
    everything = "\n".join(t for k, t in H.tokens(page) if k in "vwA")
    assert "Hello guest" in everything and "All rights kept" in everything and "Monks" in everything


def test_ties_of_runs_and_repeats():
    assert H.best_run([1, -1, 1]) == (0, 1) and H.best_run([1, -2, 1]) == (0, 1)
    weights = W | {"table": -9.0}
    assert H.extract("<p>a b</p><table></table><p>c d</p>", weights) == "a b"
    deep = '<div class="ad">' * 3000 + "x " + "</div>" * 3000
    assert H.extract(f"<p>{'word ' * 50}</p>{deep}", W) == " ".join(["word"] * 50)


def test_a_form_around_the_page_is_no_form():
    want = text_of(f"<article>{BODY}</article>")
    login = '<form action="/in"><label>Name <input name=n></label><legend>Sign in</legend><button>Go</button></form>'
    mail = "<form><p>Get our letters every week, by mail, for nothing, and never miss a word</p><button>Send</button></form>"
    for page in (
        f'<body><form id="aspnetForm" method="post"><div><nav><a href=1>Home</a></nav><div>{BODY}</div></div></form></body>',
        f"<article><form>{BODY}</form></article>",
        f"<body><form><article>{BODY}{mail}</article><footer>All rights kept</footer></form></body>",
        f"<body>{mail}<article>{BODY}</article>{login}</body>",
        f"<article>{BODY.replace('</h1>', '</h1>' + login)}</article>",
    ):
        assert text_of(page) == want, page[:70]
    assert text_of(f"<body>{login}</body>") == ""


def every_run(html):
    """The text by the definition: of all runs of tokens, the first one of the highest sum."""
    stream = H.tokens(html)
    sums = [0.0]
    for t in stream:
        sums.append(sums[-1] + H._score(t, W))
    best, at = 0.0, (0, 0)
    for i in range(len(sums)):
        for j in range(i + 1, len(sums)):
            if sums[j] - sums[i] > best + 1e-9:
                best, at = sums[j] - sums[i], (i, j)
    out = ""
    for kind, text in stream[slice(*at)]:
        out += text.replace("\n", " ") if kind in "vwA" else "\n" if text in H.BLOCKS else " " if text in H.SPACED else ""
    return "\n".join(" ".join(x.split()) for x in out.split("\n") if x.split())


def test_table_against_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r["page_id"]: every_run(r["html"]) if r["html"] else "" for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in H.extract_pages(pages).collect()}
    assert got == want and any(want.values())
