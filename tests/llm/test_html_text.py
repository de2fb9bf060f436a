"""HTML extraction: markup, host furniture, odd input."""

import random

from tidefold.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<form><p>Name</p><input></form>
<article><header><h1>Head&amp;line</h1><p>By me</p></header><p>One  <b>two</b>\n three&nbsp;&lt;x&gt;<br>four</p><div class="ad"><p>Buy</p></div><p>Five &copy; six<p>Seven
<!-- <p>hidden</p> --><script>if (a < b) {}</script><section id="comments"><p>First!</p></section></article>
<aside>More</aside><div class="sidebar"><div>deep<div>deeper</div></div>tail</div><footer>&copy; me</footer></body></html>"""


def text(page):
    return h.marked_text(h.blocks(page))


def test_article():
    assert text(PAGE) == "Head&line\nOne two three <x> four\nFive © six\nSeven"


def test_main_and_none():
    assert text("<body><div class=nav>x</div><main><h1>A</h1>b <i>c</i></main>d") == "A\nb c"
    assert text("<nav>a<main><p>b</p></main>") == "b"
    assert text("<p>a</p>") is None
    assert text("") == "" == text(None) == text("<nav>a</nav>")
    assert text("<article><p>cut of") == "cut of"
    assert text("<article>a < b and <p>c</article>") == "a < b and\nc"
    assert text('<div class="post-content"><p>a</p></div><div class="alert">b</div>') == "a"
    assert text("<article><p title=a\"b>x</p><p data-x='>' id=y>z</p><p cla") == "x\nz"
    assert text("<article>" + "<a " + 'b="c" ' * 60) == ""


def test_hosts(spark):
    furniture = "<div>Acme home page about us contact</div><ul><li>terms and all our other very fine rules here</li></ul>"
    rows = [(k, f"https://acme.example/{k}", f"{furniture}<div>Story {k} has its own words number {k} and goes on for {k} days.</div><div>buy now at our very fine shop today</div>") for k in range(4)]
    rows += [(10, "https://other.example/1", f"{furniture}<p>Only page of its host</p>"), (11, None, "<p>no host here at all, none</p>"), (12, "x", None), (13, "https://acme.example/e", "")]
    rows += [rows[0], (None, None, PAGE)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, key int")
    got = sorted(h.extract(df).collect(), key=str)
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    for k in range(4):
        assert by[k] == f"Story {k} has its own words number {k} and goes on for {k} days."
    assert by[10].startswith("Acme home page") and by[10].endswith("Only page of its host")
    assert by[11] == "no host here at all, none" and by[12] == by[13] == ""
    assert by[None].startswith("Head&line")
    assert h.extract(df.limit(0)).count() == 0


def test_names_and_odd_markup():
    assert text('<article class="post category-social">a b</article>') == "a b"
    assert text("<article class='comment-open'>a</article>") == "a" == text("<article data-u=/p/1/>a</article>")
    assert text('<article><h2 id="search-and-alerts">x</h2><p id="comment-on-x">y</p><div id="related-work">z</div></article>') == "x\ny\nz"
    assert text("<article>a<script src=/x/>var y;</script>b</article>") == "ab" == text("<article>a<script>if(a<b){t='<!--';x=\"'}</script>b</article>")
    assert text("<article>a<p class='ad'>b</p><p class='lead ad-hoc'>c</p><pre><span class='comment'># d</span></pre></article>") == "a\nc\n# d"
    assert text("<article>a <math><mi>x</mi></math></article>") == "a x"
    assert text("<form><article>body</article></form>") == "body" == text("<nav>menu<article>body</article>")
    assert text("<article>a<svg>b<p>c</article>") == "ab\nc" and text("<article>a<svg><text>b</text></svg>c</article>") == "ac"
    lesser = '<div class="share-buttons">s</div><div class="comments-area">c</div><section class="related-posts">r</section><div class="ad-300x250">d</div><aside><article>t</article></aside><article class="comment">u</article>'
    assert text(f"<article>a{lesser}</article>") == "a"


def brute_told(found, host, me, run):
    """The text of one open page among those of its host, with every window of ``run`` tokens compared one by one."""
    streams = []
    for f in host:
        tokens = ["\0"]
        for b in f:
            if b.place in ("open", "furniture"):
                tokens += [*b.text.split(" "), "\0"]
        streams.append(tokens)
    windows = [{tuple(t[i : i + run]) for i in range(len(t) - run + 1)} for t in streams]
    mine, most = streams[me], [0] * len(streams[me])
    for i in range(len(mine) - run + 1):
        n = sum(tuple(mine[i : i + run]) in w for w in windows)
        for j in range(i, i + run):
            most[j] = max(most[j], n if n > 1 else 0)

    def made(limit):
        out, i = [], 1
        for b in found:
            if b.place not in ("open", "furniture"):
                continue
            words = b.text.split(" ")
            hit = [most[i + k] >= limit for k in range(len(words))]
            i += len(words) + 1
            if b.place != "open" or b.linked >= 0.8:
                continue
            for kind in (True, False):
                pieces, k = [], 0
                while k < len(words):
                    e = k
                    while e < len(words) and hit[e] == hit[k]:
                        e += 1
                    pieces.append((k, e))
                    k = e
                for k, e in pieces:
                    if hit[k] == kind and e - k < run and e - k < len(words):
                        hit[k:e] = [not kind] * (e - k)
            kept = [w for w, h in zip(words, hit) if not h]
            if kept:
                out.append(" ".join(kept))
        return ["\n".join(out)]

    first = made(max(2, -(-len(host) // 2)))[0]
    if first:
        return first
    least, i = [], 1
    for b in found:
        if b.place in ("open", "furniture"):
            n = len(b.text.split(" "))
            if b.place == "open" and b.linked < 0.8:
                least += most[i : i + n]
            i += n + 1
    return made(min(least) + 1)[0] if least else ""


def test_array_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(40)}"
    notice = [" ".join(word() for _ in range(n)) for n in (5, 9, 14, 260)]
    rows, own = [], {}
    for host in range(4):
        shared = " ".join(word() for _ in range(25))
        for k in range(rng.randrange(1, 9)):
            body = [f"<p>{' '.join(word() for _ in range(rng.randrange(1, 40)))}" for _ in range(3)]
            body += [f"<div>{n} {word()} {n}</div>" if rng.random() < 0.3 else f"<div>{n}</div>" for n in notice if rng.random() < 0.8]
            if rng.random() < 0.4:
                body.append(f"<p>{shared}</p>")
            rng.shuffle(body)
            rows.append((len(rows), f"https://h{host}/x", "<nav>menu</nav>" + "".join(body), "t", 1))
            own.setdefault(host, []).append(h.blocks(rows[-1][2]))
    rows.append((len(rows), "https://h0/again", rows[0][2], "t", 1))  # a copy of a page
    own[0].append(own[0][0])
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, key int")
    got = {r.page_id: r for r in h.extract(df).collect()}
    want = {}
    for host in own.values():
        for me, f in enumerate(host):
            want.setdefault(f[0].text + str(f), []).append(brute_told(f, host, me, h.RUN))
    for r in rows:
        f = h.blocks(r[2])
        assert got[r[0]].text in want[f[0].text + str(f)]
    assert sum(r.n_cut for r in got.values()) > 500


def test_array_cuts_from_articles(spark):
    page = lambda k: f"<article><h1>Title {k}</h1><p>Subscribe to our weekly letter now</p>" + "".join(f"<p>Text {k} {j} of its own, long enough.</p>" for j in range(3)) + "</article>"
    rows = [(k, "https://a/x", page(k)) for k in range(4)] + [(9, "https://a/x", page(0))]  # the last: a copied article
    rows += [(20 + k, "https://b/x", page(7)) for k in range(5)] + [(30, "https://c/x", page(1)), (31, "https://c/x", page(2)), (40, None, page(3)), (41, None, page(3)), (42, None, page(3))]
    got = {r.page_id: r for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Subscribe" not in got[k].text and got[k].n_cut == 6 and got[k].text.count("\n") == 3 for k in (0, 1, 2, 3, 9))
    assert all(got[k].n_cut == 0 and got[k].text.count("\n") == 4 for k in (*range(20, 25), 30, 31, 40, 41, 42))


def test_long_page():
    assert len(h.told_text(h.blocks("<p>a b c d e f g" * 60_000), [], 1)[0].split("\n")) == 60_000
    assert text("<article>" + "<svg>" * 20_000 + "x") == "x" and text("<aside>" + "<article>a</article>" * 20_000 + "</aside>") == ""
    assert text("<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>").count("\n") == 49_999
    assert len(text("<main>" + "w " * 1_000_000)) == 1_999_999
    assert text("<article>" + "<div>" * 3000 + "x") == "x"


def test_names_of_comments_and_adverts():
    """Words of furniture anywhere in a name, unless the name is one of content."""
    for inner in ('<div class="reader-comments">x</div>', '<div id="user-comments">x</div>', '<div class="fb-comments">x</div>', '<div class="google-ads">x</div>', '<div class="entry-footer">x</div>', '<section class="site newsletter-box">x</section>'):
        assert text(f"<article><p>a</p>{inner}<p>b</p></article>") == "a\nb", inner
    assert text("<article><p>a <span class='ad'>buy <b>now</b></span>b</p><p>c</p></article>") == "a b\nc"
    for inner in ('<section id="using-cookies">x</section>', '<div class="has-sidebar">x</div>', '<div class="comments-on-law">x</div>', '<span class="comment">x</span>', '<div id="moderating-comments">x</div>'):
        assert text(f"<article><p>a</p>{inner}</article>") == "a\nx", inner


def test_the_main_one_of_several_articles():
    body = "<p>A long story with many words.</p>" * 3
    told = "\n".join(["A long story with many words."] * 3)
    assert text(f"<article>{body}</article><h2>More</h2><article class='card'><p>A teaser.</p></article><article class='card'><p>Another.</p></article>") == told
    assert text(f"<article class='card'><p>First a teaser.</p></article><article>{body}</article>") == told
    assert text(f"<article>{body}</article><article>{body}</article>") == f"{told}\n{told}"
    assert text(f"<main>{body}<div class='related-article'><p>Other</p></div></main>") == f"{told}\nOther"
    assert text(f"<div class='article-list'><p>one</p></div><div class='post-content'>{body}</div><div class='related-article'><p>Other</p></div>") == told
    assert text("<div class='article-list'><p>one</p></div><div class='related-article'><p>two</p></div>") is None
    assert text(f"<article>{body}<article class='reply'><p>no</p></article></article>") == told
