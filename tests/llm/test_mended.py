"""Cases that once went wrong: forgotten pieces of a tokenizer's cache, leaks of items with common parts."""

from collections import Counter
from math import log1p

import numpy as np
import pytest

from quillon.llm import decontam, html, licenses, packing


def test_encoder_forgets_nothing_that_the_slice_needs():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(40_000)]
    first, second = " ".join(words[:30_000]), " ".join([*words[:30_000], *words])
    for known in (100, 25_000, 40_000):
        own = packing.Encoder(path, known=known)
        for text in (first, second, first, " ".join(words[35_000:]), second):
            assert own.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_encoder_on_texts_of_megabytes():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), packing.Encoder(path, known=1000)
    rng = np.random.default_rng(2)
    text = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300_000))
    for t in (text, text + " " + text[::-1]):
        assert own.encode([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids


def similarity(doc, item, sets):
    """The best of all windows of the item's length, by sets and weights as they are defined."""
    n, df = len(sets), Counter(s for x in sets.values() for s in set(x))
    own, w = set(sets[item]), doc.split()
    places = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    weight = lambda s: log1p(n / df[s])
    whole, best = sum(map(weight, own)), 0.0
    for a in range(len(places)):
        part = places[a : a + len(sets[item])]
        best = max(best, sum(map(weight, set(part) & own)) / (whole + sum(y not in own for y in part) * log1p(n)))
    return best


def test_items_with_common_parts_are_found(spark):
    """Common beginnings and endings weigh little, however many words they have; also at places of nested and cut items."""
    ending, head = [f"end{i}" for i in range(64)], [f"head{i}" for i in range(30)]
    items = {k: [*[f"w{k}x{i}" for i in range(60)], *ending] for k in range(300)}
    items |= {300 + k: [*head, *[f"v{k}x{i}" for i in range(50)]] for k in range(50)}
    items |= {400 + k: items[k][5:45] for k in range(20)}  # inside others
    docs = {k: [*[f"f{k}x{i}" for i in range(20)], *items[k][:60]] for k in range(150)}
    docs |= {200 + k: [*items[300 + k][30:], *[f"g{k}x{i}" for i in range(9)]] for k in range(50)}
    docs |= {300 + k: ["x", *items[k][:55], "changed", *items[k][56:], "y"] for k in range(30)}
    docs |= {400 + k: [*ending, "and", *head, "only"] for k in range(3)}
    d = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(d, b).collect()}
    sets = {k: [tuple(v[j : j + 5]) for j in range(len(v) - 4)] for k, v in items.items()}
    own = {k: {w for w in v if w not in ending and w not in head} for k, v in items.items()}
    want = {}
    for i, v in docs.items():
        for k in items:
            if own[k] & set(v) or i >= 400 and k % 60 == 0:
                s = similarity(" ".join(v), k, sets)
                if s >= 0.8 - 1e-9:
                    want[i, k] = s
    assert len([k for k in want if k[0] < 150 and k[0] == k[1]]) == 150
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def page_texts(spark, pages):
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html.main_text(frame).collect()}


ARTICLE = "<article><h1>Title {i}</h1><p>Body of page {i} goes on and on.</p>{inside}</article>"
PARTS = [
    '<div class="comments"><div>Reader {i} says something new.</div></div>', '<div class="comment-list" id="c{i}"><p>Nice {i}</p></div>', '<section id="comments"><article><p>I, reader {i}, agree.</p></article></section>',
    '<article class="comment"><p>Reply {i}</p></article>', '<div class="advert">Buy thing {i} now</div>', '<aside class="x">Side {i}</aside>', '<div id="cookie-notice">We use cookies {i}</div>',
    '<form action="/x"><p>Your name {i}</p><input name="q"></form>', '<p class="ad">Ad text {i}</p>', '<ul><li>point {i}</li><li class="ad-item">ad {i}</li></ul>', '<div class="sidebar"><p>More of {i}</p></div>',
    '<div class="NewsletterSignup">Mail me {i}</div>', '<div class="notice">Site moves on day {i}</div>', '<div class="ads-container banner">Offer {i}</div>',
]


@pytest.mark.parametrize("where", ["inside", "beside", "plain", "alone"])
def test_comments_forms_adverts_and_notices_go_wherever_they_stand(spark, where):
    """Inside an article, beside it, on pages without one, on hosts of one page; their texts differ from page to page."""
    pages, want = [], {}
    for k, part in enumerate(PARTS):
        for i in range(1 if where == "alone" else 5):
            p = part.format(i=i)
            inside, beside = (p, "") if where in ("inside", "alone") else ("", p)
            body = ARTICLE.format(i=i, inside=inside) + beside if where != "plain" else f"<div class='text'><h1>Title {i}</h1><p>Body of page {i} goes on and on.</p></div>{p}"
            want[len(pages)] = f"Title {i}\n\nBody of page {i} goes on and on." + (f"\n\npoint {i}" if "point" in p and where in ("inside", "alone", "plain") else "")
            pages.append((f"http://h{k}.com/{i}", f"<html><body><nav>Menu</nav><div id='wrap'>{body}</div><footer>end</footer></body></html>"))
    got = page_texts(spark, pages)
    lists = {i for i, (_, h) in enumerate(pages) if "point" in h and where == "beside"}
    assert {i: t for i, t in got.items() if i not in lists} == {i: t for i, t in want.items() if i not in lists}


def test_names_that_only_hold_such_words_stay(spark):
    """Wrappers and sections whose names hold other words as well are text, and so is what is around an article."""
    texts = [
        '<body class="has-sidebar no-ads"><div class="sidebar-left layout"><p>Kept {i}</p></div></body>', '<article><section id="related-comments-study"><p>Kept {i}</p></section></article>',
        '<form id="aspnetForm"><div><article><p>Kept {i}</p></article></div></form>', '<form id="aspnetForm"><div><p>Kept {i}</p></div></form>', '<div class="comments"><main><p>Kept {i}</p></main></div>',
        '<div class="post comments"><p>Kept {i}</p></div>', "<article><section id='discussion'><p>Kept {i}</p></section></article>",
    ]
    pages = [(f"http://k{k}.com/{i}", t.format(i=i)) for k, t in enumerate(texts) for i in range(4)]
    got = page_texts(spark, pages)
    assert got == {n: f"Kept {n % 4}" for n in range(len(pages))}


def test_entropy_decides_the_rest(spark):
    """A box that repeats on a host's pages goes from their articles; one with texts of its own stays; both look alike."""
    pages = [(f"http://a.com/{i}", f"<main><div class='box'>Same words here</div><div class='box2'>Own words of {i}</div><p>Text {i}</p></main>") for i in range(6)]
    assert page_texts(spark, pages) == {i: f"Own words of {i}\n\nText {i}" for i in range(6)}


def test_sentences_that_name_a_licence_and_give_none(spark):
    said = {
        "Do not use the GNU General Public License for this work.": None, "Our talk explains why the GNU General Public License matters to courts.": None, "This code is NOT licensed under the MIT License.": None,
        "The unlicense movement": None, "All rights reserved by the queen were lost.": None, "Our lawyers dislike the Mozilla Public License": None, "This is not under the Apache License.": None,
        "Did they ever compare it with the BSD 3-Clause License?": None, "Foo is a small library. Licensed under the MIT License. See LICENSE.": "MIT", "GNU GENERAL PUBLIC LICENSE": "GPL",
        "SPDX-License-Identifier: BSD-3-Clause": "BSD", "The reader asked what the CC BY 4.0 means. Nobody knew.": None,
    }
    rows = list(enumerate(said))
    got = {r.doc_id: r.family for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in rows} == said


def test_licences_of_unseen_names_and_wordings(spark):
    """A model that saw neither the names nor the patterns of the test rows: what it says is mostly right, and of mentions it says nothing."""
    grams, offsets, temperature = licenses.train(spark, held_out=True)
    classes, weight = sorted(offsets), dict(grams)
    rows = licenses.model_rows(spark).where("use = 'test'").select("family", "grams").collect()
    right = said = there = wrong = 0
    for r in rows:
        z = np.array([sum(weight[g][i] for g in r.grams if g in weight) + offsets[c] for i, c in enumerate(classes)])
        best = classes[int(z.argmax())]
        said += best != licenses.UNKNOWN
        there += r.family != licenses.UNKNOWN
        right += best == r.family != licenses.UNKNOWN
        wrong += best != licenses.UNKNOWN == r.family
    assert there > 50 and right / said > 0.75 and right / there > 0.3 and wrong / (len(rows) - there) < 0.05
