import random

from schemaloom.llm.html import Runs, blocks, extract, main_text

PAGE = '<html><head><title>T</title><style>p{}</style></head><body class="page"><header><h1>Site</h1></header><nav>m</nav><main><article class="post"><header><h1>Real &amp; title</h1></header><p>One <b>two</b>\n three<p>Four<br>five<div class="ad-slot">buy</div><ul><li>x<li>y</ul><aside>s</aside><form>f<input></form></article><section id="comments"><article class="comment">c</article></section></main><div class="cookie-notice">n</div><footer>f</footer><script>if(a<b)"</p>"</script></body>'


def test_structure():
    assert extract([(1, PAGE)]) == ["Real & title\n\nOne two three\n\nFour five\n\nx\n\ny"]


def test_odd_pages():
    got = extract([(1, None), (2, ""), (3, "plain <b>text"), (4, "<!-- open"), (5, 'a < b & c &lt; d &#233; <p title="a>b">q'), (6, "<p>" * 3000 + "deep" + "<div " * 50)])
    assert got == ["", "", "plain text", "", "a < b & c < d é\n\nq", "deep"]


def test_repeated_runs_go_only_outside_main_elements():
    shared = "this same sentence of more than twelve words stands on every page of the host"
    pages = [(i, f"<div>{shared}</div><div>{i} has a text of its own</div>") for i in range(3)]
    assert extract(pages) == [f"{i} has a text of its own" for i in range(3)]
    held = [(i, f"<article><p>{shared}</p></article><div>{shared}</div>") for i in range(3)]
    assert extract(held) == [shared] * 3
    assert extract([pages[0], pages[0]])[0].startswith("this same")  # one page twice isn't two pages


def test_suffix_array_equals_brute_force():
    rng = random.Random(5)
    for _ in range(20):
        streams = [[rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(4)]
        pages = [0, 1, 1, 2]
        n = rng.randint(1, 6)
        where = {}
        for s, p in zip(streams, pages):
            for k in range(len(s) - n + 1):
                where.setdefault(tuple(s[k : k + n]), set()).add(p)
        for s, got in zip(streams, Runs(streams, pages, n).covered()):
            want = [any(len(where[tuple(s[k : k + n])]) > 1 for k in range(max(0, i - n + 1), i + 1) if k + n <= len(s)) for i in range(len(s))]
            assert list(got) == want


def test_what_structure_drops_in_a_line_and_by_name():
    assert extract([(1, '<p>Hello <span class="advert">Buy now</span> world</p>')]) == ["Hello world"]
    assert extract([(1, "<p>Hello <script>a<b</script>world <button>x</button>again</p>")]) == ["Hello world again"]
    kept = '<article><div class="ad-hoc">keep</div><section id="social-history">this</section><p class="formal notice-theory">too</p>'
    assert extract([(1, kept + '<div class="ad-slot x">no</div><ul class="comment_list"><li>no</ul><i class="share-buttons">no</i></article>')]) == ["keep\n\nthis\n\ntoo"]
    assert [extract([(1, h)]) for h in ("two words", "one", "<p>", "")] == [["two words"], ["one"], [""], [""]]
    assert extract([(1, "a b"), (2, "a b")], min_run=2) == ["", ""]


def test_blocks_that_most_articles_of_a_host_hold_go():
    line = "this line of thirteen words stands in all of the articles of one host"
    pages = [(i, f"<article><p>{line}</p><p>{' '.join(f'w{i}x{k}' for k in range(30))}</p></article>") for i in range(6)]
    assert all(line not in x and x for x in extract(pages))
    assert all(line in x for x in extract(pages[:4]))  # of few pages nothing is said
    copies = [(i, f"<article><p>{line}</p></article>") for i in range(9)]
    assert extract(copies) == [line] * 9  # copies of an article stay


def brute(pages, n):
    """Text of pages, with runs and blocks counted by plain loops."""
    cut = {i: blocks(h) for i, h in pages}
    where, holders = {}, {}
    for i, (sure, own) in cut.items():
        words = " ".join(own).split()
        if sure:
            for b in own:
                holders.setdefault(b, set()).add(i)
        else:
            for k in range(len(words) - n + 1):
                where.setdefault(tuple(words[k : k + n]), set()).add(i)
    out = {}
    for i, (sure, own) in cut.items():
        words, at, texts, gone = " ".join(own).split(), 0, [], 0
        for b in own:
            size = len(b.split())
            if sure:
                common = size >= n and len(holders[b]) >= 5 and 2 * len(holders[b]) >= len(cut)
                gone += size * common
                texts += [] if common else [b]
            else:
                hit = [any(len(where[tuple(words[k : k + n])]) > 1 for k in range(max(0, j - n + 1), j + 1) if k + n <= len(words)) for j in range(at, at + size)]
                rest = " ".join(w for w, h in zip(b.split(), hit) if not h)
                texts += [rest] if rest else []
            at += size
        out[i] = "\n\n".join(own if sure and 2 * gone >= at else texts)
    return out


def test_text_equals_brute_force_over_any_number_of_shards(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    pages = []
    for i in range(120):
        own = [rng.choice(lines[:8]) if rng.random() < 0.4 else " ".join(f"u{i}{rng.choice('xyz')}" for _ in range(5)) if rng.random() < 0.4 else rng.choice(lines) for _ in range(rng.randint(0, 6))]
        html = "".join(f"<p>{x}</p>" for x in own)
        common = f"<p>{lines[39]} {lines[39]} z z z z</p><p>{' '.join(f'v{i}{k}' for k in range(40))}</p>"
        pages.append((i, f"<article>{common}{html}</article>" if i % 3 else html))
    want = brute(pages, 4)
    df = spark.createDataFrame([(i, f"http://h.example/{i}", h) for i, h in pages], "page_id long, url string, html string")
    for chars in (10_000_000, 900):
        got = {r.page_id: r.text for r in main_text(df, 4, chars).collect()}
        assert got == want
    assert any("u0" in x for x in want.values()) and lines[39] not in want[1]


def test_tables_and_hot_hosts(spark):
    rows = [(i, f"https://host.example/{i}" if i % 3 else None, PAGE.replace("One", f"One{i}")) for i in range(30)] + [(None, "x", None), (7, "https://host.example/7", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS shard", "'x' AS text")
    for chars in (6_000_000, 3_000):
        got = main_text(df, shard_chars=chars).collect()
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        assert {r.page_id: r.text for r in got if r.page_id == 4}[4].startswith("Real & title\n\nOne4 two")
    assert main_text(df.limit(0)).count() == 0
    same = [(None, None, PAGE), (None, None, PAGE.replace("One", "Another")), (None, "http://h.example/", None)] * 2
    got = main_text(spark.createDataFrame(same, "page_id long, url string, html string")).collect()
    assert sorted(len(r.text) > 0 for r in got) == [False, False, True, True, True, True]
