import functools
import random
import re
from collections import Counter

import duckdb
import pytest

from lattica.llm import html_extract, language_id, quality, url_filter

DOC = "doc_id long, text string"


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    at = {k + j for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(at)


def brute_rejects(text):
    """Whether any rule rejects a text."""
    n, chars, symbols, dup, repeat = brute_quality(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = sum(any(c.isalpha() for c in w) for w in words)
    capitals = sum("A" <= c <= "Z" for c in text or "")
    dots = sum(x.rstrip(" \t\x0b\x0c\r").endswith(("...", "…")) for x in lines)
    bullets = sum(x.lstrip(" \t\x0b\x0c\r")[0] in "•*–-" for x in lines)
    return (
        n < 50
        or 100 * repeat > 50 * n
        or 100 * symbols > 10 * n
        or 100 * dup > 40 * len(lines)
        or not 2 * n <= chars <= 12 * n
        or 100 * letters < 50 * n
        or len(set(words)) ** 2 < n
        or (len(lines) >= 5 and (100 * dots > 30 * len(lines) or 100 * bullets > 90 * len(lines)))
        or 100 * capitals > 70 * chars
    )


def test_quality_statistics_and_cascade(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "x y z x y z", "é\u00a0ß\u2003x", "l\nl\n\nl\r\nl", "#*$%&|<>" * 20, "a b c " * 3000, "w" * 30000]
    texts += [" ".join(rng.choices("abcdefghij", k=rng.randint(0, 150))) for _ in range(40)]
    texts += ["\n".join(rng.choices([" ".join(f"q{rng.randrange(10**6)}" for _ in range(12)), "same line"], k=9)) for _ in range(20)]
    fresh = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    texts += [fresh(60), fresh(60).upper(), "\n".join(f"- {fresh(9)}" for _ in range(8)), "\n".join(f"{fresh(9)}... " for _ in range(8)), "\n".join(f"{fresh(9)}…" for _ in range(4))]
    texts += [" ".join(str(rng.randrange(10**6)) for _ in range(80)), " ".join(rng.choices([f"{a}{b}{c}" for a in "xyz" for b in "uvw" for c in "rst"], k=1200))]
    df = spark.createDataFrame([(k, t, "clash", 1, True) for k, t in enumerate(texts)], DOC + ", n_lines string, _words int, kept boolean")
    report = quality.quality_report(df)
    assert len(set(report.columns)) == len(report.columns) and "_words" in report.columns
    got = {r.doc_id: r for r in report.collect()}
    for k, t in enumerate(texts):
        r, want = got[k], brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not brute_rejects(t)) == (r.rejected_by is None), t
    kept = quality.quality_filter(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}
    assert quality.quality_report(df.limit(0)).count() == 0 and quality.quality_filter(df.limit(0)).count() == 0


def test_rules_are_ordered_by_rejections_per_cost(spark):
    rules = tuple(quality.Rule(n, (n,), "true") for n in "abcd")
    # a rejects most but is dear; b rejects what d does, and more; c rejects nothing
    verdicts = [(True, k < 4, False, k < 3) for k in range(8)] + [(False,) * 4] * 2
    costs = {"a": 4.0, "b": 1.0, "c": 0.001, "d": 1.0}
    order = quality.placed(rules, verdicts, costs)
    assert [p.rule.name for p in order] == ["b", "a", "c", "d"] and [round(p.rejects, 2) for p in order] == [0.4, 0.67, 0, 0]
    assert [p.rule.name for p in quality.placed(rules, verdicts, costs, made=("a",))][0] == "a"
    measured = quality.measured_costs(quality.draw_sample(spark.createDataFrame([(k, f"w{k} x " * 2000) for k in range(40)], DOC)), {"capitals": ("capitals",), "repeats": ("words", "repeats")})
    assert measured["repeats"] > 5 * measured["capitals"]


def test_a_rule_sees_undecided_texts_only(spark):
    """The first rule of the cascade is named, and no rule behind it is evaluated: it would raise."""
    text = " ".join(f"q{k}" for k in range(60)) + " " + "#" * 20
    df = spark.createDataFrame([(1, text)], DOC)
    by = {r.name: r for r in quality.RULES}
    trap = quality.Rule("trap", ("words",), "raise_error('evaluated') IS NULL")
    rules = (by["too_short"], by["repeated_windows"], by["symbols"], by["word_length"], trap)
    assert quality.quality_report(df, rules, order=[by["word_length"], by["symbols"], trap]).first().rejected_by == "symbols"
    with pytest.raises(Exception, match="evaluated"):
        quality.quality_report(df, rules, order=[trap, by["symbols"]]).collect()


def test_cascade_plan_is_native(spark):
    plan = quality.quality_filter(spark.createDataFrame([(1, "a")], DOC))._jdf.queryExecution().executedPlan().toString()
    plan += quality.quality_report(spark.createDataFrame([(1, "a")], DOC))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_url_filter_against_sql(spark):
    urls = [
        "http://a.com/en/7", "https://example.com/en/7", "https://www.EXAMPLE.com/en/77?x", "http://example.com/en/8#a", "x://b.net/de/", "x://example.net/de/8",
        "x://example.net/de/7", "x://my.org/es/", "x://org/es/", "x://notorg/es/", "http://spam-farm.example.org", "http://m.cheap-pills.example.com/fr/1", "http://example.com?/en/7",
        "no scheme", "", None, "://", "http://a.b.com/en/x://y", "HTTP://É.COM/en/", "http://free-bets.example.net/de/1", "http://free-bets.example.net/de/81",
    ]
    df = spark.createDataFrame([(k, u, 0) for k, u in enumerate(urls)] + [(0, urls[0], 0)], "page_id long, url string, rule int")
    got = sorted(tuple(str(x) for x in r) for r in url_filter.filter_urls(df).drop("url").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(k, u) for k, u in enumerate(urls)])
    want = {str(r[0]): tuple(str(x) for x in r) for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.OP7_SQL})").fetchall()}
    assert got == sorted([*want.values(), want["0"]])
    assert url_filter.filter_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("rate,size,small", [(1 / 256, 1 << 20, 10**5), (0.5, 1 << 20, 10**5), (0.5, 1 << 20, 200), (0.5, 1 << 20, 0), (0.5, 16, 10**5)])
def test_cascade_is_exact(spark, rate, size, small):
    rng = random.Random(7)
    universe = [f"k{rng.randrange(10**9)}" for _ in range(3000)]
    listed = set(rng.sample(universe, 300)) | {"not in the universe"}
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    lists = url_filter.shards_of(frame([*listed, *listed, None, ""]), size, rate, small)
    shards = [c for keys in lists for c in url_filter.build_cascades([keys], frame(universe * 2), rate, small)]
    assert (len(shards) > 1) == (size == 16)
    assert {k for k in universe if any(k in c for c in shards)} == listed - {"not in the universe"}
    assert "x" not in url_filter.Cascade()
    two = url_filter.build_cascades([url_filter.Keys(0, []), url_filter.Keys(2, universe[:2])], frame(universe), rate, small)
    assert {k for k in universe if k in two[1]} == set(universe[:2]) and not any(k in two[0] for k in universe)


def test_extraction_golden():
    model = default_model()
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>"
        "<!-- ad --><div class='ad'>Buy now.</div><article><h1>Title &amp; more</h1><p>One  two\n three.<br>Four <b>five</b>.<p>Of.</p><div class=comments><p>Nice post!</p></div>"
        "<form><label>Mail</label><input><button>Send</button></form></article><footer>&copy; 2024 us.</footer></body></html>"
    )
    assert html_extract.main_text(page, model) == "Title & more\nOne two three. Four five.\nOf."
    plain = "<body><div id=sidebar><p>Links here.</p></div><div class='post-content'><p>" + "A long sentence of words. " * 20 + "</p><p>Short.</p></div></body>"
    assert html_extract.main_text(plain, model) == ("A long sentence of words. " * 20).strip() + "\nShort."
    assert html_extract.main_text(None, model) == html_extract.main_text("", model) == html_extract.main_text("<p", model) == ""


@functools.cache
def default_model():
    return html_extract.train(html_extract.labelled_pages())


SAID = "The committee met on Tuesday to discuss the new plan for the harbour. Members agreed that work should start in spring."


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<main><section><h2>Part</h2><p>{SAID}</p><ul><li><a href=/a>one</a></li><li><a href=/b>two</a></li></ul></section></main>", ["Part", SAID, "one", "two"]),
        (f'<div id="content"><div class="widget-title"><p>{SAID}</p></div></div>', [SAID]),
        (f'<article class="post"><p>{SAID}</p><section><h2>B</h2><p>{SAID}</p></section></article>', [SAID, "B", SAID]),
        (
            f"<main><article><header><h1>Title</h1></header><section class='article-section'><p>{SAID}</p></section><aside class='ad-box'><p>Buy now!</p></aside>"
            "<section class='comments'><h3>Comments</h3><div class=comment><p>Nice work. I like it.</p></div></section></article></main>",
            ["Title", SAID],
        ),
        (
            f"<div id=cookie-banner><p>We use cookies. Accept?</p><button>OK</button></div><div id=main-content><h1>Q</h1><div class='faq-item'><h3>Why?</h3><p>{SAID}</p></div>"
            "<div class='faq-item'><h3>How?</h3><p>Like so.</p></div></div><div class='newsletter-signup'><form><p>Get our news.</p></form></div>",
            ["Q", "Why?", SAID, "How?", "Like so."],
        ),
        (
            "<nav><ul><li><a href=/>Home</a></li></ul></nav><main><h1>List</h1><ol><li>First step.</li><li>Second step</li></ol><pre>code here</pre>"
            "<table><tr><th>A</th><td>1</td></tr></table></main><div class='social-share'><a href=#>Send</a></div>",
            ["List", "First step.", "Second step", "code here", "A", "1"],
        ),
        (
            f"<header><h1>Site</h1></header><main><article><h1>T</h1><p>{SAID}</p><div class='entry-meta'>By Ann</div><ol><li>Alpha beta.</li></ol></article>"
            "<div id='disqus_thread'><p>Great!</p></div></main>",
            ["T", SAID, "By Ann", "Alpha beta."],
        ),
        (
            f"<div class='navbar'><ul><li><a href=/>Home</a></li></ul></div><div class='container'><div class='row'><div class='col-8'><h1>T</h1><p>{SAID}</p><p>{SAID}</p><p>{SAID}</p></div>"
            "<div class='col-4'><div class='widget'><h4>Tags</h4><ul><li><a href=/t>t</a></li></ul></div></div></div></div>",
            ["T", SAID, SAID, SAID],
        ),
        (f"<h1>T</h1><p>{SAID}</p><p>{SAID}</p>", ["T", SAID, SAID]),
        (f"<div><div><div><h2>Head</h2><div>{SAID}</div><div>{SAID}</div><div>{SAID}</div></div></div></div>", ["Head", SAID, SAID, SAID]),
        (f"<article><p>{SAID}</p><noscript>Enable JS</noscript><template><p>no</p></template></article>", [SAID]),
        (
            f"<header id=masthead class=site-header><a href=/>Blog</a></header><div id=primary class=content-area><main id=main class=site-main><article id=post-12 class='post type-post'>"
            f"<header class=entry-header><h1 class=entry-title>Plan</h1></header><div class=entry-content><p>{SAID}</p><ul><li>First</li></ul></div></article><nav class=post-navigation>"
            "<a href=#>Older</a></nav><div id=comments class=comments-area><h2>2 thoughts</h2><ol class=comment-list><li class=comment><p>I disagree. It is wrong.</p></li></ol></div></main></div>"
            "<aside class=widget-area><section class=widget><h2>Recent</h2><ul><li><a href=#>x</a></li></ul></section></aside>",
            ["Plan", SAID, "First"],
        ),
        (
            f"<div class=ad-slot>Sponsored: buy shoes.</div><div class=story-wrapper><h1 class=story-title>Plan</h1><p class=byline>By Ann Lee</p><figure><img><figcaption>The harbour.</figcaption></figure>"
            f"<div class=story-body><p>{SAID}</p><div class=inline-ad><p>Advertisement</p></div><blockquote>{SAID}</blockquote><p>Short.</p></div><div class=related-stories><h3>More</h3><ul><li><a href=#>Other</a>"
            "</li></ul></div></div><div class=cookie-bar>We use cookies.</div>",
            ["Plan", "By Ann Lee", "The harbour.", SAID, SAID, "Short."],
        ),
        (f"<main><h1>Shoe</h1><p>{SAID}</p><button>Buy</button><section class=reviews><h2>Reviews</h2><div class=review><p>Great shoes.</p></div></section></main>", ["Shoe", SAID]),
        ("<div class=cookie>We use cookies.</div><nav><ul><li><a href=/>x</a></li></ul></nav><footer><p>Copyright 2020 us. All rights reserved.</p></footer>", []),
        (f"<div class=comments><p>{SAID}</p><p>{SAID}</p></div><form><p>{SAID}</p></form>", []),
        (f"<main role=main><h1>T</h1><dl><dt>A</dt><dd>{SAID}</dd></dl><details><summary>More</summary><p>{SAID}</p></details></main>", ["T", "A", SAID, "More", SAID]),
        ("<nav><a href=/>x</a></nav><footer>c</footer>", []),
        *((f'<div id="{name}"><h1>Film</h1><p>{SAID}</p></div>', ["Film", SAID]) for name in ("review", "product-review", "reviews", "reply", "film")),
        (SAID, [SAID]),
        (f"{SAID} <b>Bold.</b><br>Next line", [f"{SAID} Bold. Next line"]),
        (
            f"<div role=banner><p>{SAID}</p></div><div role=main><h1>T</h1><p>{SAID}</p></div><div role=complementary><h2>More</h2><p>Other news of the week.</p></div>"
            "<div role=contentinfo><p>All rights reserved by us.</p></div>",
            ["T", SAID],
        ),
        (f"<div id=qc-cmp2-container><p>We and our partners use data. You may agree.</p></div><article><h1>T</h1><p>{SAID}</p></article>", ["T", SAID]),
    ],
)
def test_extraction_of_hand_made_pages(body, want):
    """Layouts that no generator made."""
    model = default_model()
    assert html_extract.main_text(f"<html><head><title>x</title></head><body>{body}</body></html>", model).split("\n") == (want or [""])


def test_extraction_held_out():
    model = default_model()
    wrong = total = 0
    for html, mark in html_extract.labelled_pages(150, seed=1234):
        dom = html_extract.parse_dom(html)
        label = [0] * len(dom.tag)
        chance = model.marginals(dom)
        for node in range(1, len(dom.tag)):
            label[node] = label[dom.parent[node]]
            if dom.tag[node][0] != "#" and mark in dom.data[node]:
                label[node] = int(dom.attributes(node)[mark])
            if dom.tag[node] == html_extract.TEXT and dom.data[node].strip():
                total += 1
                wrong += (chance[node] >= html_extract.KEEP) != label[node]
    assert wrong < 0.02 * total


def test_marginals_are_exact():
    """Against a sum over all labellings of a small page."""
    import itertools
    import math

    model = html_extract.train(html_extract.labelled_pages(100))
    dom = html_extract.parse_dom("<div class=post><p>Some words here.</p><ul class=menu><li>x</li></ul></div>")
    seen = html_extract.observations(dom)
    n = len(dom.tag)
    weight = [[0.0, 0.0] for _ in range(n)]
    total = 0.0
    for labels in itertools.product((0, 1), repeat=n):
        score = math.log((0.98, 0.02)[labels[0]])
        for k in range(n):
            score += sum(model.own[x][labels[k]] for x in seen[k] if x in model.own)
            if k:
                score += model.edges(dom)[k][labels[dom.parent[k]]][labels[k]]
        p = math.exp(score)
        total += p
        for k in range(n):
            weight[k][labels[k]] += p
    assert all(abs(weight[k][1] / total - m) < 1e-9 for k, m in enumerate(model.marginals(dom)))


def test_extraction_frame(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<article><p>Hi &eacute;.</p></article>", "x"), (2, None, "<article><p>Hi &eacute;.</p></article>", "x")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract_main_text(df).collect())
    assert got == [(1, "", 0), (2, "Hi é.", 5), (2, "Hi é.", 5)]
    assert html_extract.extract_main_text(df.limit(0)).count() == 0
    here, there = html_extract.train(html_extract.labelled_pages(300)), html_extract.trained(spark, 300)
    assert here.edge == there.edge and here.own == there.own  # counted in the workers


WORDS = {"en": "the and of to in is that with for this", "fr": "le la et les des une dans que pour avec", "de": "der die und das ist nicht ein mit auf den"}


def language_rows(rng, n=90):
    docs, pages = [], []
    for k in range(n):
        lang = sorted(WORDS)[k % 3]
        text = " ".join(rng.choices(WORDS[lang].split(), k=40))
        docs.append((k, lang if k % 5 else None, f"s{k % 4}", text if k % 11 else None))
        declared = f' lang="{lang}"' if k % 3 else ""
        body = text if k % 7 else ""
        pages.append((k, f"http://h{k % 3}.example.{'fr' if lang == 'fr' else 'com'}/x", f"<html{declared}><article><p>{body}</p></article></html>"))
    return docs, [*pages, (900, None, None), (901, "x://localhost", ""), (902, "x://h0.example.com", "<html lang=zz></html>")]


def test_language_fusion_against_brute_force(spark):
    import math

    docs, pages = language_rows(random.Random(3))
    d = spark.createDataFrame(docs, "doc_id long, lang string, source string, text string")
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(("document", r.doc_id) if r.page_id is None else ("page", r.page_id)): (r.language, r.probability) for r in language_id.identify(d, p).collect()}
    model = language_id.fit_text_model(language_id.labelled_sample(d))
    markup = default_model()
    items = []
    for i, _, source, text in docs:
        items.append((("document", i), source, None, None, None, text or ""))
    for i, url, html in pages:
        declared = re.search(r'lang="?(\w\w)', html or "")
        items.append((("page", i), *language_id._address(url), declared and declared[1], html_extract.main_text(html, markup)))
    n = len(model.languages)
    votes = {k: Counter() for k in ("host", "parent", "suffix", "declared")}
    own, scores = [], []
    for ident, host, parent, suffix, declared, text in items:
        s, size = model.scores([text])
        scores.append(s[0])
        own.append(int(s[0].argmax()) if size[0] else -1)
        for name, value in (("host", host), ("parent", parent), ("suffix", suffix), ("declared", declared)):
            if value is not None:
                votes[name][ident[0], value, own[-1]] += 1
    world = [(own.count(k) + 1) / (len([x for x in own if x >= 0]) + n) for k in range(n)]
    for (ident, host, parent, suffix, declared, _), s, mine in zip(items, scores, own):
        prior = world
        for name, value in (("parent", parent), ("host", host)):
            if value is not None:
                c = [votes[name][ident[0], value, k] - (mine == k) for k in range(n)]
                prior = [(c[k] + 8 * prior[k]) / (sum(c) + 8) for k in range(n)]
        fused = [s[k] + math.log(prior[k]) for k in range(n)]
        for name, value in (("declared", declared), ("suffix", suffix)):
            if value is not None:
                kinds = len({v for _, v, _ in votes[name]}) + 1
                for k in range(n):
                    total = sum(c for (_, _, x), c in votes[name].items() if x == k)
                    fused[k] += math.log((votes[name][ident[0], value, k] - (mine == k) + 1) / (total - (mine == k) + kinds))
        best = max(range(n), key=lambda k: (fused[k], -k))
        assert got[ident][0] == model.languages[best], ident
        assert abs(got[ident][1] - 1 / sum(math.exp(f - fused[best]) for f in fused)) < 1e-6


def test_language_held_out_and_empty(spark):
    docs, pages = language_rows(random.Random(5), 150)
    d = spark.createDataFrame(docs, "doc_id long, lang string, source string, text string")
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    truth = {k: sorted(WORDS)[k % 3] for k in range(150)}
    got = language_id.identify(d, p, sample_docs=40).collect()
    right = [r.language == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id % 11] + [r.language == truth[r.page_id] for r in got if r.page_id is not None and r.page_id < 150 and r.page_id % 7]
    assert sum(right) >= 0.99 * len(right)
    assert language_id.identify(d.limit(0), p.limit(0)).count() == 0


def test_rare_languages_are_found(spark):
    rng = random.Random(9)
    alphabet = {"en": "etaoinshr", "de": "nisratdhu", "fr": "esaitnrul", "xx": "qzjxkwvyp"}
    word = {lang: ["".join(rng.choices(a, k=rng.randint(3, 8))) for _ in range(200)] for lang, a in alphabet.items()}
    langs = [("en", "de", "fr")[k % 3] for k in range(1500)]
    for k in (100, 700, 1300):
        langs[k] = "xx"
    rows = [(k, " ".join(rng.choices(word[lang], k=60)), lang, f"s{k % 5}") for k, lang in enumerate(langs)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    p = spark.createDataFrame([], "page_id long, url string, html string")
    sample = language_id.labelled_sample(d, 40)
    assert {lang for lang, _ in sample} == set(alphabet) and len(sample) == 63
    got = {r.doc_id: r.language for r in language_id.identify(d, p, sample_docs=40).collect()}
    assert all(got[k] == "xx" for k in (100, 700, 1300))
