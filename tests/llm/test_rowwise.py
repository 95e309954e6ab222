"""Quality rules, token counts, licenses, toxicity and web pages: row by row against plain versions."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import html_text, license_scan, quality_rules, token_counts, toxicity

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_quality(text):
    words, lines = SPACE.findall(text or ""), [x for x in (text or "").split("\n") if SPACE.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    hit = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(odd_docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality_rules.ledger(odd_docs, carry=True).select("row.text", *names).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert tuple(r[n] for n in names) == plain_quality(r.text)


def test_further_quality_counts(odd_docs, spark):
    """Words and lines of every kind, among them lines of white space and letters that look like others."""
    texts = ["The ſ be BE thé\nTo, of…\n", "- a...\n\t• b…  \r\n-\n* \u2028c.\n \n", "{x} {} \u017fthe 12 3.\u0085\n“Yes.”\rno!\n", "12 34 ٣ é Ω\u212a"]
    docs = odd_docs.select("text").union(spark.createDataFrame([(t,) for t in texts], "text string"))
    ledger = quality_rules.ledger(docs.withColumn("doc_id", F.lit(1)), carry=True)
    for r in ledger.collect():
        text = r.row.text or ""
        words, lines = SPACE.findall(text), [x.rstrip(" \t\r") for x in text.split("\n") if SPACE.search(x)]
        assert r.n_stop_words == sum(lower(w) in quality_rules.STOP_WORDS for w in words)
        assert r.n_lettered == sum(any(c > "\x7f" or c.isalpha() for c in w) for w in words)
        assert r.n_bullets == sum(x.lstrip(" \t")[:1] in ("-", "*", "•") and x.lstrip(" \t") != "" for x in lines)
        assert r.n_ellipses == sum(x.endswith(("...", "…")) for x in lines)
        assert r.n_ended == sum(x.endswith((".", "!", "?", '"', "”", "。", "！", "？")) for x in lines)
        assert r.n_braces == text.count("{") + text.count("}")


def test_a_stored_ledger_serves_every_policy(odd_docs):
    stored = quality_rules.store(odd_docs)
    assert stored.inputFiles()
    bits = [r.failed_bits for r in stored.collect()]
    for policy in quality_rules.POLICIES:
        mask = quality_rules.policy_mask(policy) | quality_rules.policy_mask("base")
        assert quality_rules.apply_policy(stored, policy).filter("kept").count() == sum(b & mask == 0 for b in bits)
        assert quality_rules.keep(odd_docs, policy).count() == sum(b & mask == 0 for b in bits)
    plan = quality_rules.keep(odd_docs, "v1")._jdf.queryExecution().optimizedPlan().toString()
    assert "[-*•]" not in plan and "[-*•]" in quality_rules.keep(odd_docs, "v2")._jdf.queryExecution().optimizedPlan().toString()


def test_quality_policy_keeps_columns_and_drops_failures(odd_docs, no_docs):
    kept = quality_rules.keep(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 7]
    assert quality_rules.keep(no_docs).count() == 0


def test_ablation_counts_what_one_rule_alone_rejects(odd_docs):
    ledger = quality_rules.ledger(odd_docs)
    bits = [r.failed_bits for r in ledger.collect()]
    for policy in ("v1", "v2"):
        mask = quality_rules.policy_mask(policy)
        for r in quality_rules.ablation(ledger, policy).collect():
            bit = quality_rules.BIT[r.rule]
            assert (r.n_docs, r.n_failed, r.n_only) == (len(bits), sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits))


def test_token_counts_are_the_library_s(odd_docs, no_docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted((r.doc_id or 0, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd_docs, path).collect()) == want
    assert token_counts.count_tokens(no_docs, path).count() == 0


def test_token_counter_on_random_strings():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    counter = token_counts.Counter(path, token_counts.prove(path))
    pool = ["a", "é", " ", "  ", "\n", "\t", " ", "9", "²", "!", "'s", "'ll", "<|endoftext|>", "漢", "😀", "\x1c", "\x85", "́", "\r\n"]
    rng = np.random.default_rng(1)
    for _ in range(3000):
        text = "".join(rng.choice(pool, rng.integers(0, 12)))
        assert counter.count(text) == counter.merged(text)


def plain_base(text):
    words = PLAIN.findall(lower(text))
    starts, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)


def test_license_base_phrases(odd_docs, no_docs):
    by_text = sorted(plain_base(r.text)[:2] for r in odd_docs.collect())
    got = license_scan.scan(odd_docs).selectExpr("*", "aggregate(base, 0L, (a, x) -> a + x.n) as n").collect()
    assert sorted((r.n_words, r.n) for r in got) == by_text
    assert license_scan.scan(no_docs).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the GNU General Public License, version 3 or later.", ["gpl-3+"]),
        ("LGPL-2.1 here", ["lgpl-2.1"]),
        ("Creative Commons Attribution-ShareAlike 4.0", ["cc-by-sa-4.0"]),
        ("CC BY-NC 4.0", ["cc-by-nc-4.0"]),
        ("the BSD 3-Clause license", ["bsd-3"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", ["mit"]),
        ("nothing of the kind", []),
    ],
)
def test_license_rules(spark, text, labels):
    found = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().detections
    assert [d.label for d in found] == labels


def test_toxicity_learns_and_takes_odd_rows(spark, sf, odd_docs, no_docs):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(odd_docs, model, carry=True)
    assert scored.count() == odd_docs.count() and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert scored.select("row.*").columns == odd_docs.columns
    assert toxicity.score(no_docs, model).count() == 0
    one = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.score(odd_docs, toxicity.fit(docs, one)).filter("score <> 0").count() == 0
    assert toxicity.score(odd_docs, toxicity.fit(docs, one.limit(0))).filter("score <> 0").count() == 0


def test_toxicity_separates_planted_words():
    rng = np.random.default_rng(0)
    hasher = toxicity.Hasher()
    words = [f"w{i}" for i in range(3000)]
    texts, labels = [], []
    for i in range(900):
        own = list(rng.choice(words, 80))
        if i % 6 == 0:
            for place in rng.integers(0, 80, 3):
                own[place] = rng.choice(["vile", "rotten", "filthy"])
        texts.append(hasher.text(" ".join(own).encode()))
        labels.append(int(i % 6 == 0))
    labels = np.array(labels)
    net, thresholds = toxicity.train(texts[:600], labels[:600], ["en"] * 600, 1 / 6)
    said = net.score(texts[600:]) >= 0.3
    assert (said == labels[600:]).mean() > 0.97
    assert 0 < thresholds["en"] < 1


def test_a_long_text_scores_as_its_parts_together():
    net, _ = toxicity.train([np.array([i % 7 << 32 | i % 5]) for i in range(60)], np.array([int(i % 7 == 3) for i in range(60)]), ["en"] * 60, 0.2)
    text = np.arange(1000, dtype=np.int64) % 11 << 32
    whole = net.score([text])
    toxicity.CHUNK, kept = 100, toxicity.CHUNK
    try:
        assert np.allclose(net.score([text]), whole)
    finally:
        toxicity.CHUNK = kept


PAGES = [
    ('<div id=main><p>Short one.</p><div class="comments"><p>I disagree, you, all, of, you.</p></div></div>', "Short one."),
    (
        "<body><header><h1>Site</h1></header><main><h1>Title</h1><p>Text &amp; more &lt;b&gt;.</p><aside>related</aside>"
        '<ul><li>one<li>two</ul><form>Sign up</form></main><div class="cookie-notice">We use cookies, ok, fine</div></body>',
        "Title\nText & more <b>.\none\ntwo",
    ),
    ("<article><p>a<br>b\n  c<p>d</article><footer>x</footer>", "a b c\nd"),
    ("<p>just a paragraph<p>and another", "just a paragraph\nand another"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("plain text", "plain text"),
    (
        '<div id="header">Site</div><div class="menu"><a href="/">Home</a></div><h1>Title</h1><div class="post"><div><p>' + "Long text, with commas, " * 20
        + "</p></div><div><p>Short.</p></div></div><div id='comments'><p>" + "I think, so, " * 90 + '</p></div><div id="footer">end</div>',
        "Title\n" + ("Long text, with commas, " * 20).strip() + "\nShort.",
    ),
    (
        '<div id="wrap"><ul><li><a href="a">a</a><li><a href="b">b</a></ul><div class="x"><p>One, two.</p><p>Three.</p></div></div>',
        "One, two.\nThree.",
    ),
    ("<table><tr><td><a href=a>menu</a></td><td><p>Text, in a layout table.</p></td></tr></table>", "Text, in a layout table."),
    ('<script>var a = "<p>no</p>";</script><p>yes, this one</p><!-- <p>no</p> -->', "yes, this one"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert html_text.extract(page) == text


def test_pages_table(spark, sf):
    rows = [(1, "u", PAGES[0][0], "t"), (1, "u", PAGES[0][0], "t"), (None, None, None, None)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract_text(odd).collect()) == [(0, "", 0), (1, "Short one.", 10), (1, "Short one.", 10)]
    assert html_text.extract_text(odd.limit(0)).count() == 0
    assert html_text.query(spark, sf).filter("n_chars = 0").count() == 0


# --- pages by construction


def planted_page(rng):
    """(html, text): an article between pieces that are none, in one of several layouts."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    paragraph = lambda: ", ".join(" ".join(rng.choice(words, 8)) for _ in range(int(rng.integers(3, 7)))) + "."
    blocks = [("h1", " ".join(rng.choice(words, 4)))] + [("p", paragraph()) for _ in range(int(rng.integers(3, 8)))]
    article = "".join(f"<{t}>{x.replace('beta', '<b>be</b>ta').replace('mu', '&#109;u')}</{t}>\n" for t, x in blocks)
    junk = [
        "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>",
        "<form action=/search><p>Search the site, or the archive</p><input name=q><button>Go</button></form>",
        "<div class=related><p><a href=/x>One more story</a></p><p><a href=/y>And another</a></p></div>",
        "<aside><p>An aside of a few words, with a comma</p></aside>",
        "<div class='comments'><p>I think, therefore, that this is wrong, and long, and more.</p></div>",
        "<footer><p>All rights reserved, by us</p></footer><script>var a = '<p>x</p>';</script>",
    ]
    wrap = [("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<div id=content>", "</div>"), ("<form method=post><input type=hidden><div>", "</div></form>"), ("<div class='share wide'><div>", "</div></div>")]
    a, b = wrap[int(rng.integers(len(wrap)))]
    order = [junk[i] for i in rng.permutation(len(junk))]
    page = f"<html><head><title>t</title></head><body>{''.join(order[:3])}{a}{article}{b}{''.join(order[3:])}</body></html>"
    return page, "\n".join(x for _, x in blocks)


def test_planted_articles_are_found_whole():
    rng = np.random.default_rng(8)
    for page, text in (planted_page(rng) for _ in range(300)):
        assert html_text.extract(page) == text, page


def test_references_are_decoded_in_their_own_text():
    assert html_text.extract("<article><p>fish &am<b>p; chips</b> &amp; peas &#233;</p></article>") == "fish &amp; chips & peas é"


def test_deep_pages_take_time_in_proportion():
    def seconds(n):
        began = time.process_time()
        assert html_text.extract("<div>" * n + "<p>some text, and more" + "</i></div>" * n) == "some text, and more"
        return time.process_time() - began

    seconds(1000)
    assert seconds(32_000) < 16 * max(seconds(4000), 0.05)


FIVE = "".join(f"<p>This is a long paragraph number {i}, with commas, and enough words to count as text of an article.</p>" for i in range(5))


@pytest.mark.parametrize("words", "site has-sidebar|content no-sidebar|layout-with-nav|menu-closed wrap|article-with-comments|comments-enabled|modal-open|reply-page|ad-free|sidebar|page hide-cookie-notice".split("|"))
def test_wrappers_with_common_class_words_keep_their_article(words):
    """Wrappers as site themes write them; real sidebars and comments inside and beside them go."""
    bare = f'<body><div class="{words}">{FIVE}</div></body>'
    full = f'<body><nav><a href=x>a</a></nav><div class="{words}"><h1>T</h1>{FIVE}<div class="left-sidebar"><p>Side text, not wanted, at all.</p></div></div><div class="comments"><p>Reader says, yes, no.</p></div></body>'
    for page in (bare, full):
        text = html_text.extract(page)
        assert text.count("long paragraph") == 5 and "Side text" not in text and "Reader" not in text


def test_short_articles_forms_and_longer_comments():
    assert html_text.extract(f"<body><form><fieldset>{FIVE}</fieldset></form></body>").count("long paragraph") == 5
    assert html_text.extract("<body><div><div>Short.</div><div>One.</div><div>Third part here.</div></div></body>") == "Short.\nOne.\nThird part here."
    article = "Short article text, only one line of it, but the real one it is indeed, it has more than one hundred characters."
    assert html_text.extract(f'<body><div class="article"><p>{article}</p></div><div class="comments">{FIVE * 3}</div></body>') == article


def test_pages_are_read_in_linear_time():
    def seconds(page):
        began = time.process_time()
        html_text.extract(page)
        return time.process_time() - began

    for page in (lambda n: "<ul>" + "<div>" * n + "<li>" * n, lambda n: "<b><div>" + "<i>" * n + "</b>" * n):
        assert seconds(page(24_000)) < 1 + 8 * seconds(page(6_000))
