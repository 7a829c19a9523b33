import random

from wardlog.llm import url_filter, warc
from wardlog.llm.html_text import Page, extract, host_votes, winning_paths

SHELL = ('<html><head><title>t</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body><nav><ul><li><a '
         'href="/x">Menu</a></ul></nav><div class="ad">Buy</div><div class="cookie-notice"><p>We use</p></div>{body}<aside>side'
         '</aside><div id="comments"><p>reader says a lot of things, really a lot of them, more than all the rest of it</p></div>'
         '<form><p>Your name</p></form><footer>&copy; me</footer></body></html>')


def page(body):
    return SHELL.format(body=body)


def test_text_of_one_page():
    cases = {
        page("<article><h1>A &amp; B</h1><p><b>one\n two<br><p>three&nbsp;&lt;<i>4</i>&gt;</article>"): "A & B\none two\nthree <4>",
        page('<main><header><h1>T</h1><span>by me</span></header><p>x</p><!-- <p>no</p> --></main>'): "T\nx",
        page('<div class="post-12"><p>first, and so on.</p><ul><li>a<li>b</ul></div>'): "first, and so on.\na\nb",
        "": "", "plain": "plain", "<p>a<p>b": "a\nb", "<article>cut <p>off": "cut\noff", "<p>1 < 2 & 3": "1 < 2 & 3",
        "<article><p>a</p><div class='share'>s</div><p hidden>h</p><p style='display: none'>n</p>b": "a\nb",
        "<article>" + "<div>" * 3000 + "deep": "deep"}
    for source, want in cases.items():
        assert Page(source).main_text(None) == want, source[:80]


def test_names_are_judged_whole_and_by_place():
    cases = {
        "<div class='content no-sidebar'><h1>T</h1><p>one</p></div>": "T\none",
        "<div class='wrap'><div class='entry hidden-print-header'><p>the article at its length</p></div><div>x</div></div>": "the article at its length",
        "<article><p>a</p><blockquote class='reply'>b</blockquote><p class='alert'>c</p><div class='alert'>d</div></article>": "a\nb\nc",
        "<p>AT&<b>amp;T</b> &am<i>p;</i></p>": "AT&amp;T &amp;",
        "<div class='sidebar-layout'><main><p>text of it</p></main></div><div>foo</div>": "text of it",
        "<article><p>a</p></article><div class='comments-area'><h1>Readers</h1>" + "<p>they say more than all of it</p>" * 9 + "</div>": "a",
        "<article><p>long enough to be the article</p></article><div class='main-nav'>m</div><div class='site-footer'>f</div>":
            "long enough to be the article"}
    for source, want in cases.items():
        assert Page(source).main_text(None) == want, source[:80]


def test_many_layouts_come_back_as_written():
    """Pages put together from blocks that are known to belong to the article or not."""
    rng = random.Random(12)
    words = ["alpha", "Bêta", "&lt;tag&gt;", "a&amp;b", "3 &times; 4", "x<em>y</em>z", "end.", "<a href='/q'>link</a>", "日本"]
    plain_of = {"&lt;tag&gt;": "<tag>", "a&amp;b": "a&b", "3 &times; 4": "3 × 4", "x<em>y</em>z": "xyz", "<a href='/q'>link</a>": "link"}
    noise = ["<div class='ad'>{}</div>", "<aside>{}</aside>", "<div id='sidebar-left'>{}</div>", "<ul class='share-buttons'><li>{}</ul>",
             "<div role='dialog'>{}</div>", "<form><p>{}</p></form>", "<div class='cookie notice'><p>{}</p></div>", "<p hidden>{}</p>",
             "<!-- {} -->", "<script>'{}</p>'</script>", "<div class='comments'><p>{}</p></div>", "<section class='related-posts'>{}</section>"]
    wraps = ["<article class='post no-sidebar'>{}</article>", "<main>{}</main>", "<div class='content has-comments'>{}</div>",
             "<div id='page'><div class='post-{n}'>{}</div></div>", "<section><article>{}</article></section>"]
    inner = ["<p>{}</p>", "<h2>{}</h2>", "<p>{}", "<ul><li>{}</ul>", "<blockquote class='quote'>{}</blockquote>", "<div class='text'>{}</div>", "<pre>{}</pre>"]
    for n in range(300):
        lines, parts = [], []
        for _ in range(rng.randint(2, 9)):
            said = [rng.choice(words) for _ in range(rng.randint(12, 40))]
            parts.append(rng.choice(inner).format(" \n".join(said)))
            lines.append(" ".join(plain_of.get(w, w) for w in said))
            if rng.random() < .4:
                parts.append(rng.choice(noise).format("noise " * rng.randint(1, 6)))
        body = rng.choice(wraps).replace("{n}", str(n)).format("".join(parts))
        out = [rng.choice(noise).format("noise " * rng.randint(1, 9)) for _ in range(4)]
        source = f"<body><header>top</header>{out[0]}{out[1]}{body}{out[2]}{out[3]}<footer>f</footer></body>"
        assert Page(source).main_text(None) == "\n".join(lines), source


def test_deep_pages_take_linear_work():
    import time
    seconds = []
    for n in (5_000, 40_000):
        start = time.perf_counter()
        deep = Page("<div class='a b'><ul><li>" * n + "deep")
        assert deep.main_text(None) == "deep" and max(map(len, deep.votes())) < 500
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 40 * seconds[0]


def test_ties_of_votes_go_to_the_larger_path(spark):
    votes = spark.createDataFrame([("h", "/a", 5, 1), ("h", "/b", 5, 1), ("h", "/c", 4, 9)], "host string, path string, votes bigint, pages bigint")
    assert [r.path for r in winning_paths(votes).collect()] == ["/b"]


def test_the_host_s_path_wins(spark):
    long_aside = "<div class='box'><p>" + "a much longer text about something else. " * 30 + "</p></div>"
    rows = [(i, f"http://H.example/{i}", page(f"<div class='story-{i}'><p>Story {i}, told here at some length for a vote.</p></div>"))
            for i in range(9)]
    rows.append((9, "http://h.example/9", page("<div class='story-9'><p>Story 9.</p></div>" + long_aside)))
    rows += [(10, None, None), (11, "x", ""), (None, "http://h.example/", page("<article><p>other</p></article>")), (1, None, "<p>a")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    got = extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {(r.page_id, r.url): r.text for r in got}
    assert texts[9, "http://h.example/9"] == "Story 9." and texts[10, None] == "" and texts[11, "x"] == ""
    assert texts[None, "http://h.example/"] == "other" and texts[1, None] == "a"
    assert extract(pages.limit(0)).count() == 0
    votes = host_votes(pages.selectExpr("'h' as host", "html"))
    assert {r.path for r in winning_paths(votes).collect()} == {"/body/div.story-#"}


def url_plain(url, listed):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for said, domain, start in url_filter.RULES:
        if (host == domain or host.endswith("." + domain)) and path.startswith(start):
            if best is None or len(domain + start) > len(best[0]):
                best = domain + start, said
    return host, path, best and best[0], best[1] if best else "block" if host in listed else "allow"


def test_urls_agree_with_a_plain_version(spark):
    rng = random.Random(4)
    hosts = [f"{a}.example.{b}" for a in ("www", "X-1", "spam-farm", "a.b") for b in ("org", "com", "net")] + [
        "org", "com", "notcom", "é.net", ""]
    ends = ["", "/", "/es/", "/en/1", "/en/12", "/fr/x", "/de/?q", "?q=/fr/", "#://", "/a://b"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(ends)}" for _ in range(400)] + [None, "", "nothing", "://", "a\n://b.org/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    listed = {"spam-farm.example.net", "", "é.net"}
    got = url_filter.judge_urls(pages, spark.createDataFrame([(h,) for h in [*listed, "unseen", None]], "key string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: url_plain(u, listed) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages.limit(0), url_filter.listed_by_name(pages)).count() == 0


def test_cascade_is_exact_over_many_keys(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD_KEYS", 2_000)
    keys = spark.range(20_000).selectExpr("concat('k', id) as key", "id")
    listed = keys.where("id % 7 = 0").select("key")
    for most in (url_filter.FILTER_BYTES, 0):          # sent to every task, and joined shard by shard
        monkeypatch.setattr(url_filter, "FILTER_BYTES", most)
        levels, shards = url_filter.cascade(keys.select("key"), listed)
        assert shards == 10 and levels.agg({"level": "max"}).first()[0] > 2
        wrong = url_filter.with_membership(keys, "key", levels, shards).where("listed <> (id % 7 = 0)")
        assert wrong.count() == 0


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_ROWS", 20)
    rows = [(i, f"http://e.org/{i}", f"<p>page {i % 40} of many, with é</p>" * 8) for i in range(90)]
    rows += [(200, None, None), (201, "a\r\nb", ""), (None, "n", "only here"), (None, "n", ""), (300, "z", "\x00\n" * 50_000), (5, "again", rows[5][2])]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int").coalesce(2)
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and not [r.error for r in got if r.error]
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    seen = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert seen == sorted((str(p), "response" if p == first.get(h or "", p) else "revisit",
                           None if p == first.get(h or "", p) else first[h or ""], len((h or "").encode())) for p, _, h in rows)
    texts = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert texts[300] == b"\x00\n" * 50_000 and texts[7] == rows[7][2].encode()
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    assert len(files) > 4
    raw = files[0].read_bytes()
    assert all(len(list(warc.records_of(p.read_bytes()))) < 20 for p in files)
    for broken in (raw[:-12], raw[:len(raw) // 2], b"xx" + raw):
        try:
            list(warc.records_of(broken))
            raise AssertionError("accepted")
        except ValueError:
            pass
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    good = warc.record(1, None, b"abc", None, False)
    for bad in (good[4:], good.replace(b"abc", b"abd"), good[:-1], good.replace(b"WARC-Date", b"X")):
        try:
            warc.parse(bad)
            raise AssertionError("accepted")
        except ValueError:
            pass
