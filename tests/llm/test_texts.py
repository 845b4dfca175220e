import itertools
"""Extraction, personal data, language, media: against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import struct

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from synthloom.llm import extraction, language, media, pii
from synthloom.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in sorted(out))


HARD = [
    "a@b.c_x@e.f a@b..c @x.y a@b@c.de x.y%z@q-r.s.t. \U0001f600 me@x.yz",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.2.3 12345.1.1.1 1.2.3 9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 4111  1111 1111 1111 0000000000000",
    "+1 (555) 123-4567 +12 +1234567890123456 ++1 555 123 4567. +1.2.3.4.5.6.7.8.9",
    "x" * 5000 + "@" + "a." * 3000 + "b",
    "9" * 20000,
    "",
    None,
]


def test_pattern_spans(spark):
    texts = HARD + [f"{a}{b}{c}" for a in ("1.2.3.4", "a@b.cd", "+49 170 123456") for b in ("", " ", ".", "@", "-", "+") for c in ("5.6.7.8", "x@y.z", "4111111111111111")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", pii.described(pii.base_spans(F.coalesce("t", F.lit("")))).alias("s")).collect()}
    assert got == {i: brute_spans(t or "") for i, t in enumerate(texts)}


def test_query_digests(spark, sf):
    rows = QUERIES["op4_pii"](spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(f"{k}:") for k in PLAIN]


def test_disclosing_terms_are_sanitised(spark):
    rows = [(i, f"plain words number {chr(97 + i % 26)}{chr(97 + i // 26)}xyz and more common talk", None) for i in range(200)]
    rows += [(900 + i, f"Write to Zebulon at zeb@mail.org about the common talk {'abcdefghij'[i]}qqqq, says zebulon", None) for i in range(4)]
    rows += [(990, None, 7), (991, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int")
    out = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert len(out) == len(rows) and out[990].text is None and out[991].text == "" and out[990].base == 7
    for i in range(4):
        assert "zebulon" not in out[900 + i].text.lower() and "[EMAIL]" in out[900 + i].text and "common talk" in out[900 + i].text
    assert all(out[i].text == rows[i][1] for i in range(200))
    assert pii.sanitised(docs.limit(0)).count() == 0


def test_terms_of_any_form_anywhere_are_sanitised(spark):
    filler = "and more of the common talk on plain words " * 12
    rows = [(i, f"{filler} number {chr(97 + i % 26)}{chr(97 + i // 26)}xyz") for i in range(200)]
    names = ("Kim", "Anne-Marie", "O'Neil", "EMP12345")
    rows += [(900 + i, f"{' '.join(names)}, {filler} {'abcdefghij'[i]}qqqq zeb@mail.org") for i in range(4)]
    out = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(4):
        assert not any(name.lower() in out[900 + i].lower() for name in ("kim", "anne", "marie", "neil", "emp12345"))
        assert "[EMAIL]" in out[900 + i] and filler.strip() in out[900 + i] and f"{'abcdefghij'[i]}qqqq" in out[900 + i]
    assert all(out[i] == rows[i][1] for i in range(200))


def brute_actions(texts, at=pii.DISCLOSED_AT, support=pii.SUPPORT, prior=pii.PRIOR):
    """{text: {term: level}} by the definition, with Python's own loops."""
    term = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['\u2019-][\p{L}\p{M}\p{N}]+)*")
    texts = set(texts)
    held, beside, words = {}, {}, {}
    for text in texts:
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute_spans(text).split(",") if s]
        named = set()
        for s, (a, b) in zip(brute_spans(text).split(","), spans, strict=False):
            value, kind = text[a:b], s.split(":")[0]
            if kind == "email":
                named |= {value.lower(), "@" + value.lower().split("@")[-1]}
            elif kind == "ip":
                named |= {value, "net" + ".".join(value.split(".")[:3])}
            else:
                digits = re.sub("[^0-9]", "", value)
                named |= {kind + digits, kind + "s" + digits[: 6 if kind == "card" else 5]}
        held[text] = named
        cut = "".join(" " if any(a <= i < b for a, b in spans) else c for i, c in enumerate(text))
        beside[text] = set(term.findall(cut.lower()))
        words[text] = set(term.findall(text.lower()))

    def classes(t):
        kind = "word" if regex.fullmatch(r"[\p{L}\p{M}]+", t) else "number" if regex.fullmatch(r"\p{N}+", t) else "code"
        return f"[{kind} of {len(t)}]", f"[{kind}]"

    def share(n_term, n_entity, both):
        rate = n_entity / max(2, len(texts))
        return math.log2((both + prior * rate) / (n_term + prior) / rate) / -math.log2(rate) if rate < 1 else 0.0

    out = {}
    for entity in set().union(*held.values()):
        near = [t for t in texts if entity in held[t]]
        if len(near) < support:
            continue
        for t in set().union(*(beside[x] for x in near)):
            both = sum(t in beside[x] for x in near)
            with_entities = sum(t in beside[x] for x in texts if any(sum(e in held[y] for y in texts) >= support for e in held[x]))
            n_term = max(sum(t in words[x] for x in texts), with_entities)
            if both < support or share(n_term, len(near), both) < at:
                continue
            level = 3
            for k, c in reversed(list(enumerate(classes(t)))):
                among = sum(any(c in classes(w) for w in beside[x]) for x in near)
                if share(max(among, sum(any(c in classes(w) for w in words[x]) for x in texts)), len(near), among) < at:
                    level = k + 1
            for x in near:
                if t in beside[x]:
                    out.setdefault(x, {})[t] = max(out.get(x, {}).get(t, 0), level)
    return out


def test_disclosure_is_that_of_its_definition(spark):
    rng = random.Random(4)
    common = [f"{a}{b}" for a in "abcdefgh" for b in ("alu", "ore", "in")]
    texts = []
    for i in range(160):
        words = rng.choices(common, k=12)
        if i % 5 == 0:
            team = rng.randrange(3)
            words += [f"Code{team}x", f"zulu-{team}", f"me{i}@team{team}.org", "aluminium" if team else "kilo"]
        if i % 11 == 0:
            words += [f"10.0.{i % 2}.{i}", f"rack{i % 2}", "+49 170 1234567"]
        rng.shuffle(words)
        texts.append(" ".join(words))
    texts += texts[:9] + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    wide, names = pii.found(docs)
    got = {r.text: dict(zip(r.told, r.levels, strict=True)) for r in wide.select("text", F.col(names["told"]).alias("told"), F.col(names["levels"]).alias("levels")).collect() if r.told}
    want = brute_actions([t or "" for t in texts])
    assert got == want and len({k for held in want.values() for k in held.values()}) >= 2


def test_lists_of_entities_make_no_pairs(spark, monkeypatch):
    """Two versions of a list of k lines: the rows that are counted grow with k, not with its square."""
    made = {}
    real = pii.written

    def counted(df, name):
        out = real(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(pii, "written", counted)
    for k in (30, 240):
        text = "\n".join(f"Person{i} Family{i} p{i}@host{i}.org, +49 170 {1000000 + i}" for i in range(k))
        docs = spark.createDataFrame([(1, text), (2, text + " changed"), *((j, f"other words {j}") for j in range(3, 600))], "doc_id int, text string")
        wide, names = pii.found(docs)
        told = {r.doc_id: set(r.t or ()) for r in wide.select("doc_id", F.col(names["told"]).alias("t")).collect()}
        assert told[1] >= {f"person{i}" for i in range(k)} | {f"family{i}" for i in range(k)} and not told[3]
        out = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
        assert not re.search(r"person|family|@|\+49", out[1].lower())
    for name, n in made.items():
        assert max(n) <= 8 * 2 * 240 + 600, name  # two lists of 240 lines, eight of whose terms a line are counted


def test_long_texts_with_many_spans(spark):
    text = "".join(f"words before u{i}@h{i}.org and after \U0001f600 " for i in range(1500))
    docs = spark.createDataFrame([(1, text), (2, "a@b.cd"), (3, "x" * 9000 + " a@b.cd")], "doc_id int, text string")
    out = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert out[1] == re.sub(r"u\d+@h\d+\.org", "[EMAIL]", text) and out[2] == "[EMAIL]" and out[3] == "x" * 9000 + " [EMAIL]"
    (spans,) = docs.filter("doc_id = 1").select(pii.described(pii.base_spans(F.col("text")))).first()
    assert spans == brute_spans(text)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1><ul><li><a href="/">Home</a></ul></header>
<div class="cookie-banner">We use cookies for the best of all that is on this site and for you and us.</div>
<main><article><h1>Heading &amp; more</h1><p>The first paragraph is about   the weather &#233; and it is one of the longest in the text.</p><div class="advert">Buy one of the best that there is for all of you and for the rest of us now.</div>
<p>Short.<p>Another one that was not closed but is of the same kind as the first, and it has <a href="x">a link</a> in it.
<script>var x = "</p><p>the and of to in is that it</p>";</script><form>Your name and the address of the one that is to be told <input></form></article>
<section id="comments"><article class="comment"><p>I think that the text is one of the best of all that I have read on this.</p></article></section></main>
<aside><p>The sidebar is one of the things that was not in the article and is for all of the readers.</p></aside><footer>&copy; all of it</footer></body></html>"""


def test_extraction():
    assert extraction.main_text(PAGE).split("\n") == [
        "Heading & more",
        "The first paragraph is about the weather é and it is one of the longest in the text.",
        "Short.",
        "Another one that was not closed but is of the same kind as the first, and it has a link in it.",
    ]
    assert extraction.main_text("") == "" and extraction.main_text("just text") == "just text"


STORY = "The first paragraph is about the weather and it is one of the longest in the text."
MORE = "The second one is on the same thing as the first, and it was not in the way of the others."


def test_extraction_hides_only_what_is_hidden():
    for seen in ('class="content overflow-hidden"', 'style="overflow:hidden"', 'data-hidden="true"', 'title="none is hidden here"', "hidden=false", 'data-style="display:none"', 'data-id="comments"'):
        assert extraction.main_text(f"<div {seen}><p>{STORY}</p></div>") == STORY, seen
        assert extraction.main_text(f"<main {seen}><p>{STORY}</p></main>") == STORY, seen
        assert extraction.main_text(f"<article><div {seen}><p>{STORY}</p></div><p>{MORE}</p></article>") == f"{STORY}\n{MORE}", seen
    for unseen in ("hidden", "HIDDEN class=x", 'hidden=""', 'aria-hidden="true"', 'style="color:red; display : none"', "style='display:none!important'"):
        assert extraction.main_text(f"<article><div {unseen}><p>{STORY}</p></div><p>{MORE}</p></article>") == MORE, unseen


def test_extraction_takes_whole_names_for_marks():
    for name in ("layout has-sidebar", "no-sidebar", "layout--sidebar", "search-results", "page-with-sidebar"):
        assert extraction.main_text(f'<div class="{name}"><p>{STORY}</p></div>') == STORY, name
    assert extraction.main_text(f'<article class="post tag-search category-legal"><p>{STORY}</p></article>') == STORY
    for mark in ("discussion", "related-work", "search", "legal"):
        page = f'<article><p>{STORY}</p><section id="{mark}"><h2 id="{mark}">Heading</h2><p>{MORE}</p></section></article>'
        assert extraction.main_text(page) == f"{STORY}\nHeading\n{MORE}", mark
    for name in ("sidebar", "cookie-banner", "comment-list", "sideBar", "sidebar-left", "post-share-buttons"):
        assert extraction.main_text(f'<div><p>{STORY}</p></div><div class="{name}"><p>{MORE}</p></div>') == STORY, name


def test_extraction_of_what_lies_within_lines_and_scripts_off():
    assert extraction.main_text(f"<article><noscript><p>{STORY}</p></noscript><p>{MORE}</p></article>") == f"{STORY}\n{MORE}"
    assert extraction.main_text(f"<noscript>Please let scripts run, as the page is not to be seen without them.</noscript><article><p>{STORY}</p></article>") == STORY
    assert extraction.main_text(f"<article><p>{STORY} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>") == f"{STORY} x=2"
    assert extraction.main_text(f'<article><p>{STORY} <span class="advert">Buy <span>it</span> now</span><em>Yes.</em></p><p>{MORE}</p></article>') == f"{STORY} Yes.\n{MORE}"
    assert extraction.main_text(f'<article><p>{STORY} <ins id="ad">not closed</p><p>{MORE} <span class="lead">Lead.</span></p></article>') == f"{STORY}\n{MORE} Lead."


def brute_two_passes(parts):
    """The rules on (text, characters in links) by their definition, each undecided block looking at all others."""
    words = extraction._WORDS

    def first(text, linked):
        if linked > extraction.LINK_DENSITY * len(text):
            return False
        found = words.findall(text.lower())
        stops = sum(w in extraction.STOP_WORDS for w in found)
        return True if len(text) >= extraction.LENGTH and found and stops / len(found) >= extraction.STOP_DENSITY and linked <= 0.2 * len(text) else None

    long = [t for t, linked in parts if len(t) >= extraction.LENGTH and linked <= 0.2 * len(t)]
    if sum(len(t) for t in long if first(t, 0)) < extraction.KNOWN * sum(map(len, long)):  # no language with a list
        labels = [False if linked > extraction.LINK_DENSITY * len(t) else True if t in long else None for t, linked in parts]
    else:
        labels = [first(*p) for p in parts]
    out = []
    for i, label in enumerate(labels):
        before = next(((i - j, not labels[j]) for j in range(i - 1, -1, -1) if labels[j] is not None), None)
        after = next(((j - i, not labels[j]) for j in range(i + 1, len(parts)) if labels[j] is not None), None)
        out.append(label if label is not None else not min(x for x in (before, after) if x)[1] if before or after else True)
    return out


def test_two_passes_decide_where_no_mark_does():
    rng = random.Random(6)
    kept = [0, 0]
    for _ in range(300):
        parts, page = [], []
        for k in range(rng.randrange(1, 14)):
            shape = rng.randrange(4)
            text, linked = {
                0: (f"{k} {STORY}", 0),
                1: (f"menu {k} about contact", len(f"menu {k} about contact")),
                2: (f"Short line {k}.", 0),
                3: (f"{k} Datenblatt Messwert Reglerkennlinie Sollwertgeber Drehzahlmesser Anschlussplan Klemmleiste", 0),
            }[shape]
            parts.append((text, linked))
            tag = rng.choice(("p", "div", "li", "h2"))
            page.append(f"<{tag}>{f'<a href=x>{text}</a>' if linked else text}</{tag}>")
        want = [text for (text, _), keep in zip(parts, brute_two_passes(parts), strict=True) if keep]
        assert extraction.main_text(f"<body><div>{''.join(page)}</div></body>") == "\n".join(want)
        kept[0] += len(want)
        kept[1] += len(parts)
    assert 0.2 < kept[0] / kept[1] < 0.9


def test_extraction_of_languages_without_a_list():
    for prose in (
        "Tämä on pitkä kappale suomeksi ja siinä kerrotaan säästä sekä siitä miten ihmiset viettävät kesää järven rannalla.",
        "To jest długi akapit po polsku, w którym opisano pogodę oraz to, jak ludzie spędzają lato nad jeziorem i w górach.",
        "这是一个很长的段落，用来说明网页正文的提取方法不应该依赖于停用词表，因为世界上有许多语言，而停用词表只包含其中的四种语言，所以必须使用长度和链接密度来判断每一个段落。",
    ):
        for box in ("article", "div"):
            page = f'<div><a href="/a">Home</a> <a href="/b">About the site</a></div><{box}><h1>Title</h1><p>{prose}</p><p>{prose}</p></{box}><div><a href="/c">Next page of them</a></div>'
            assert extraction.main_text(page) == f"Title\n{prose}\n{prose}", (box, prose)


def test_extraction_of_odd_markup():
    assert extraction.main_text(f'<a name="top"><p>{STORY}</p><p>{MORE}</p>') == f"{STORY}\n{MORE}"
    assert extraction.main_text(f'<p>{STORY}</p><p><a id="x">{MORE}</a></p><p><a href="y">{MORE}</a></p>') == f"{STORY}\n{MORE}"
    assert extraction.main_text(f"<p>{STORY}</p><!--><p>{MORE}</p><!---><p>{STORY}</p><!-- > no --!><p>{MORE}</p>") == f"{STORY}\n{MORE}\n{STORY}\n{MORE}"
    assert extraction.main_text(f"<p data-x=\"a < b\">{STORY}</p><p title='1 <b> 2'>{MORE}</p>") == f"{STORY}\n{MORE}"
    assert extraction.main_text(f'<p title="open>{STORY}</p><p>{MORE}</p>') == f"{STORY}\n{MORE}"
    box = '<div class="elementor-widget elementor-widget-text"><div class="elementor-widget-container"><p>%s</p></div></div>'
    assert extraction.main_text(f"{box % STORY}{box % MORE}<p>{STORY}</p>") == f"{STORY}\n{MORE}\n{STORY}"
    assert extraction.main_text(f'<article><div class="hero-banner"><p>{STORY}</p></div><div class="text-widget"><p>{MORE}</p></div></article>') == f"{STORY}\n{MORE}"


def test_extraction_marks_never_empty_a_page():
    assert extraction.main_text(f'<h1>Title</h1><div class="page-sidebar"><p>{STORY}</p><div class="share">Tell us</div></div>') == f"Title\n{STORY}"
    assert extraction.main_text(f'<div class="x-widget"><p>{STORY}</p></div><div class="x-widget"><p>{MORE}</p></div>') == f"{STORY}\n{MORE}"
    assert extraction.main_text(f'<div class="page-header"><p>{STORY}</p></div>') == STORY
    assert extraction.main_text(f'<div class="widget" hidden><p>{STORY}</p></div><nav class="widget"><p>{MORE}</p></nav>') == ""


def test_extraction_keeps_a_story_beside_a_teaser():
    got = extraction.main_text(f"<div><p>{STORY}</p><p>{MORE}</p></div><article><p>{MORE}</p></article>")
    assert got.startswith(f"{STORY}\n{MORE}")
    assert extraction.main_text(f"<div><p>{STORY}</p></div><article><p>{MORE}</p><p>{STORY}</p></article>") == f"{MORE}\n{STORY}"


def test_extraction_is_linear_and_survives_broken_pages():
    for page in ('<a href="' * 20000, "<p " * 50000, "<" * 100000, "<div>" * 20000 + "x" + "</section>" * 20000, "<!--" * 20000, "<select>" * 20000, "<p>x" * 20000):
        extraction.main_text(page)


def test_extraction_of_tables(spark, sf):
    import html as h

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op3_extraction"](spark, sf).collect()}
    for p in pages:
        article = re.sub(r"</?b>|<br>", " ", re.search(r"(?s)<article>(.*?)</article>", p.html)[1])
        want = "\n".join(x for x in (" ".join(h.unescape(y).split()) for y in re.split(r"</?(?:p|h1)>", article)) if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (want, len(want))
    odd = spark.createDataFrame([(1, None, "old"), (1, "", "old")], "page_id long, html string, text string")
    assert [r.text for r in extraction.extract(odd).collect()] == ["", ""]
    assert extraction.extract(odd.limit(0)).count() == 0


def test_language_held_out(spark, sf):
    rows = {r.doc_id: r for r in QUERIES["op6_language"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = [d for d in docs if rows[d.doc_id].held_out]
    assert len(rows) == len(docs) and 0.2 < len(held) / len(docs) < 0.45
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_of_odd_texts(spark):
    model = language.fitted(["the cat and the dog", "der hund und die katze"] * 5, ["en", "de"] * 5)
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "12 ² !", 0.5), (4, "the dog und", 0.5), (4, "the dog und", 0.5), (5, "der hund " * 5000, 0.5)], "doc_id long, text string, score double")
    got = language.identified(docs, model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en", "de"] and got[0].score == 0
    assert language.identified(docs.limit(0), model).count() == 0
    nothing = language.identified(docs, language.fitted([], []))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_gradient_is_that_of_the_likelihood():
    """What fitting takes for expected labels and transitions, against finite differences of the sum over all label sequences."""
    rng = np.random.default_rng(3)
    k, lengths = 3, np.array([4, 1, 5])
    e, t = rng.normal(size=(10, k)), rng.normal(size=(k, k))

    def log_z(e, t):
        total, at = 0.0, 0
        for n in lengths:
            total += math.log(sum(math.exp(sum(e[at + i, y] for i, y in enumerate(ys)) + sum(t[a, b] for a, b in itertools.pairwise(ys))) for ys in itertools.product(range(k), repeat=int(n))))
            at += n
        return total

    model = language.Crf(list("abc"), np.zeros((1, k)), t)
    p, forward = model.forward_backward(e, lengths)
    links = model.links(p, forward, np.array([0, 1, 2, 5, 6, 7, 8])).sum(axis=0)
    h = 1e-5
    for i, j in itertools.product(range(k), range(k)):
        d = np.zeros((k, k))
        d[i, j] = h
        assert links[i, j] == pytest.approx((log_z(e, t + d) - log_z(e, t - d)) / (2 * h), abs=1e-6)
    for i, j in itertools.product(range(10), range(k)):
        d = np.zeros((10, k))
        d[i, j] = h
        assert p[i, j] == pytest.approx((log_z(e + d, t) - log_z(e - d, t)) / (2 * h), abs=1e-6)


def test_marginals_equal_word_by_word_recursion():
    rng = np.random.default_rng(1)
    k, lengths = 3, np.array([1, 0, 5, 64, 65, 200])
    model = language.Crf(list("abc"), np.zeros((1, k)), rng.normal(size=(k, k)))
    e = rng.normal(size=(int(lengths.sum()), k))
    got, at = model.marginals(e, lengths), 0
    for n in lengths:
        psi, step = np.exp(e[at : at + n]), np.exp(model.transitions)
        f, b = np.ones((n, k)), np.ones((n, k))
        for t in range(n):
            f[t] = psi[t] * (f[t - 1] @ step if t else 1)
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = step @ (psi[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = f * b / (f * b).sum(axis=1, keepdims=True) if n else f
        assert np.allclose(got[at : at + n], want)
        at += n


def test_code_switched_words():
    en, de = "the house and a garden with some trees", "der garten und ein haus mit vielen"
    model = language.fitted([en, de] * 20, ["en", "de"] * 20)
    words = language.words_in(f"{en} {de}")
    p = model.marginals(language.scores(model.weights, words), np.array([len(words)]))
    assert [model.labels[k] for k in p.argmax(axis=1)] == ["en"] * len(en.split()) + ["de"] * len(de.split())


def test_media_round_trip(spark, sf):
    rows = {r.doc_id: r for r in QUERIES["op8_media"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for d in docs:
        raw = (d.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == __import__("zlib").crc32(payload[-32:]) and r.media_bytes > len(payload)


@pytest.mark.parametrize("frames", [1, 9, 10, 11, 35])
def test_probe(frames):
    payload = bytes(range(256)) * 9 * frames
    payload = payload[: 576 * frames]
    file = media.movie(payload)
    found = media.probed(file)
    assert found["codec"] == "raw " and (found["width"], found["height"]) == (24, 24) and found["duration"] == frames * 24
    assert b"".join(file[a : a + n] for a, n in zip(found["offsets"], found["sizes"], strict=True)) == payload
    assert found["keys"].tolist() == list(range(0, frames, 12))
    assert [p[-1] for p, _, _ in media.walk(memoryview(file), 0, len(file))][:3] == [b"ftyp", b"moov", b"mvhd"]


def test_damaged_files(spark):
    whole = media.movie(b"x" * 576)
    for cut in range(0, len(whole), 7):
        media._features(whole[:cut])
    assert media.probed(struct.pack(">I4s", 4, b"moov")) is None
    df = spark.createDataFrame([(1, None, "x"), (2, b"junk", "x"), (3, whole, "x")], "k int, media binary, codec string")
    assert [r.n_samples for r in media.probe_media(df).collect()] == [None, None, 1]


def test_long_texts_are_one_chain(spark):
    rng = random.Random(1)
    en, de = "the cat and the dog are in the old house", "der hund und die katze sind im alten haus"
    model = language.fitted([en, de] * 20, ["en", "de"] * 20)
    reader = language.Reader(model)
    texts = [" ".join(rng.choice((en, de)).split()[rng.randrange(9)] for _ in range(900)), "\u00b2 \u00b3", "der " * 400, ""]
    whole, parts = reader.predicted(texts), reader.predicted(texts, at_once=70)
    assert whole[0] == parts[0] and whole[0][1] == whole[0][3] == "und" and np.allclose(whole[1], parts[1], atol=1e-9)
    rows = [(i, (en, de)[i % 2], ("en", "de")[i % 2]) for i in range(40)] + [(7, de, "de")] * 500 + [(99, "x" * 100 + " un chat", "fr"), (100, None, "fr"), (101, en, None)]
    pieces, langs = language.sampled(spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(3), rows=15)
    assert {x: langs.count(x) for x in set(langs)} == {"en": 15, "de": 15, "fr": 1} and "un chat" in pieces
