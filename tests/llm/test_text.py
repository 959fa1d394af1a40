import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, awkward, empty, rows
from wardflow.llm import quality
from wardflow.llm.decontamination import blocks, find_leaks, fingerprint
from wardflow.llm.html_text import extract_pages, main_text
from wardflow.llm.language_id import fit_languages, identify, keep_identified, language_id, mixture, trigram_counts
from wardflow.llm.licences import scan_licences
from wardflow.llm.quality import Network, quality_scores, score, train

SF = "/root/testdata/sf0.01"


# --- language ---------------------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    right, all_ = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert all_ > 200 and right > 0.98


def test_mixture_has_both_languages_of_a_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_languages(docs)
    texts = {r["lang"]: r["text"] for r in docs.filter("lang IN ('en', 'de') AND length(text) BETWEEN 3000 AND 6000").orderBy("doc_id").collect()}
    both = mixture(model, (texts["en"][:2000] + " " + texts["de"][:1000]).encode())
    assert set(both) == {"en", "de"} and both["en"] > both["de"] > 0.2 and abs(sum(both.values()) - 1) < 1e-6
    assert set(mixture(model, texts["en"].encode())) == {"en"}


def test_language_of_awkward_rows(spark):
    got = {r["doc_id"]: r for r in language_id(awkward(spark)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5))
    assert got[1]["lang_pred"] in ("en", "fr", "de") and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id(awkward(spark)).count() == len(AWKWARD) and language_id(empty(spark)).count() == 0
    nothing = fit_languages(empty(spark))
    assert {r["lang_pred"] for r in identify(awkward(spark), nothing).collect()} == {"und"}


def test_rows_without_a_language_go_with_all_columns_kept(spark):
    docs = spark.createDataFrame([(1, "hello there", "en", "x"), (2, "123 !!", "en", "y"), (3, None, None, None)], "doc_id long, text string, lang string, extra string")
    assert rows(keep_identified(docs, fit_languages(docs))) == [(1, "hello there", "en", "x")]


def test_unlabelled_rows_go_only_without_a_letter(spark):
    docs = spark.createDataFrame([(1, "hello there", None), (2, "123 !!", None), (3, None, None), (4, "", None), (5, "été", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in keep_identified(docs, fit_languages(docs)).orderBy("doc_id").collect()] == [1, 5]


def test_trigrams_of_blocks_add_up(monkeypatch):
    from wardflow.llm import language_id as module

    text = (" ".join(str(i) + "wort" for i in range(3000))).encode()
    whole = trigram_counts(text)
    monkeypatch.setattr(module, "BLOCK", 1000)
    assert (trigram_counts(text) == whole).all() and whole.sum() == len(text) - 2


# --- quality ----------------------------------------------------------------------------------------------------------


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality_scores(docs.join(labels.select("doc_id"), "doc_id"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert (got.loc[got["quality"] == 0, "predicted"] == 0).mean() > 0.85


def test_score_reads_the_whole_text_in_overlapping_chunks(monkeypatch):
    net = Network.new(1)
    text = bytes(random.Random(2).randrange(32, 120) for _ in range(5003))
    whole = score(net, text)
    monkeypatch.setattr(quality, "CHUNK", 256)
    assert abs(score(net, text) - whole) < 1e-5
    assert score(net, text[:-1] + b"\xff") != pytest.approx(whole, abs=1e-9) or score(net, text + b"\xff" * 40) != pytest.approx(whole, abs=1e-9)
    assert 0 <= score(net, b"") <= 1


@pytest.mark.parametrize("text", [bytes(range(40, 110)), b"ab", bytes(np.random.default_rng(2).integers(32, 127, 40_000).tolist())])
def test_score_is_that_of_a_plain_convolution(text):
    """Every filter at every place, one after the other."""
    net = Network.new(4)
    padded, found, at = list(text), [], 0
    while at == 0 or at + quality.WIDTH - quality.STRIDE < len(text):
        window = (padded[at : at + quality.WIDTH] + [256] * quality.WIDTH)[: quality.WIDTH]
        inputs = np.concatenate([net.embedding[b] for b in window]).astype(np.float64)
        found.append(np.maximum(inputs @ net.filters.astype(np.float64) + net.bias, 0))
        at += quality.STRIDE
    pooled = np.concatenate((np.max(found, 0), np.mean(found, 0)))
    want = 1 / (1 + np.exp(-(pooled @ net.dense.astype(np.float64) + net.offset[0])))
    assert score(net, text) == pytest.approx(want, abs=1e-5)


def test_gradient_equals_differences():
    net, text, rng = Network.new(3), bytes(range(40, 110)), np.random.default_rng(0)
    for part in net.parts():
        part[...] = part.astype(np.float32)
    _, gradient = quality._gradient(net, text, 1, 1.0, rng)
    for part, got in zip(net.parts(), gradient):
        at = np.unravel_index(np.abs(got).argmax(), part.shape)
        old, step = part[at], 1e-2
        part[at] = old + step
        up = -np.log(score(net, text))
        part[at] = old - step
        down = -np.log(score(net, text))
        part[at] = old
        assert (up - down) / (2 * step) == pytest.approx(float(got[at]), rel=0.15, abs=2e-3)


def test_quality_without_labels_and_with_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_scores(awkward(spark), none)
    assert got.count() == len(AWKWARD) and {r["score"] for r in got.collect()} == {0.5}
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (8, 0, 0), (7, 1, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    assert quality_scores(awkward(spark), some).count() == len(AWKWARD)
    assert quality_scores(empty(spark), some).count() == 0
    assert train([b"a"], [1]).offset[0] > 0 > train([b"a"], [0]).offset[0]


# --- pages ------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (1 < 2) document.write("<p>no</p>")</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a>News</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h2>A  heading</h2><p>First &amp; <b>bold</b> text, with a<br>break. It is long enough to count.</p><p>Second&nbsp;one &lt;here&gt;; and more, and more.
<ul><li>An item.</li><li>Another.</li></ul><form><input name=q><button>Go</button></form><div class="ad">Buy now!</div></article>
<div id="comments"><p>Great article, thanks.</p></div><aside>Side</aside><footer>&copy; us</footer><!-- a comment --></body></html>"""


def test_main_text_of_a_page():
    want = "A heading\nFirst & bold text, with a break. It is long enough to count.\nSecond one <here>; and more, and more.\nAn item.\nAnother."
    assert main_text(PAGE) == want


def test_main_text_without_an_article_element():
    body = "".join(f"<p>Paragraph {i} has a sentence, and another one. It goes on for a while, as text does.</p>" for i in range(5))
    menu = "<div>" + "".join(f"<div><a href='/{i}'>Link {i}</a></div>" for i in range(12)) + "</div>"
    text = main_text(f"<html><body>{menu}<div>{body}</div>{menu}</body></html>")
    assert text.count("\n") == 4 and "Link" not in text


LINES = [f"Paragraph {i} has a sentence, and another one. It goes on for a while, as text does, and so on; then it ends." for i in range(6)]


@pytest.mark.parametrize("names", ["content no-sidebar", "site has-sidebar", "main with-comments", "menu-open", "page ad-free", "widget", "sidebar-left layout"])
@pytest.mark.parametrize("tag", ["article", "main", "section"])
def test_layout_names_do_not_drop_the_article(names, tag):
    text = "".join(f"<p>{x}</p>" for x in LINES)
    page = f"<body><div class='cookie-notice'>We use cookies.</div><div class='{names}'><{tag}>{text}</{tag}></div><div class='site-footer'>Imprint</div></body>"
    assert main_text(page).split("\n") == LINES


def test_heading_of_an_article_outside_of_it():
    text = "".join(f"<p>{x}</p>" for x in LINES)
    page = "<body><div class='site-header'>Site</div><div class='entry-header'><h1>A title</h1></div>{}<ol class='comment-list'><li><article class='comment-body'><p>{}</p></article></li></ol></body>"
    for body in (f"<article>{text}</article>", f"<div class='entry-content'>{text}</div>"):
        assert main_text(page.format(body, LINES[0])).split("\n") == ["A title", *LINES]


@pytest.mark.parametrize("wrap", ["<div>{}</div>", "<div><div>{}</div></div>", "{}"])
def test_lists_and_tables_inside_the_text_of_a_div_page_stay(wrap):
    long = [f"Number {i}. " + "This is a long sentence, with a comma and a stop. " * 9 for i in range(6)]
    paragraphs = [f"<p>{x}</p>" for x in long]
    items = [f"item number {i} of a list of short items." for i in range(6)]
    cells = [f"cell {i}" for i in range(8)]
    listed, table = "".join(f"<li>{x}</li>" for x in items), "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in zip(cells[::2], cells[1::2]))
    body = "".join([*paragraphs[:2], f"<ul>{listed}</ul>", *paragraphs[2:4], "<div><h3>A heading</h3></div>", f"<table>{table}</table>", *paragraphs[4:]])
    menu = "<div>" + "".join(f"<div><a href='/{i}'>Link {i}</a></div>" for i in range(12)) + "</div>"
    want = [" ".join(x.split()) for x in [*long[:2], *items, *long[2:4], "A heading", *cells, *long[4:]]]
    assert main_text(f"<html><body>{menu}{wrap.format(body)}{menu}</body></html>").split("\n") == want


@pytest.mark.parametrize("source, want", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>cut of", "cut of"), ("<p>a &am", "a &am"), ("<p>5 < 6", "5 < 6"), ("<script>x", ""),
    ("<!-- open", ""), ("<p title='a > b'>in</p>", "in"), ("<p>one</p></div></p><p>two", "one\ntwo"),
])
def test_main_text_of_broken_markup(source, want):
    assert main_text(source) == want


def test_pages_of_the_corpus_and_awkward_rows(spark):
    got = extract_pages(spark.read.parquet(f"{SF}/pages.parquet")).toPandas()
    assert (got["n_chars"] == got["text"].str.len()).all() and (got["n_chars"] > 0).all() and not got["text"].str.contains("<p>").any()
    odd = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>Hi.</p>", "y"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    assert rows(extract_pages(odd)) == sorted([(1, None, "", 0), (None, "u", "Hi.", 3), (1, None, "", 0)], key=repr)
    assert extract_pages(odd.limit(0)).count() == 0


# --- leaks and licences -----------------------------------------------------------------------------------------------


def test_blocks_meet_every_print_within_the_radius(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(range(64), rng.randrange(21)):
            b ^= 1 << i
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        pairs.append((signed(a), signed(b)))
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("i", F.monotonically_increasing_id())
    left, right = df.select("i", blocks(F.col("a"), 20).alias("x")), df.select("i", blocks(F.col("b"), 20).alias("x"))
    assert left.join(right, ["i", "x"]).select("i").distinct().count() == 300


def test_fingerprint_counts_every_bit(spark):
    rng = random.Random(4)
    lists = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 5, 40, 0)]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<bigint>").orderBy("i").select(fingerprint(F.col("x"))).collect()]
    want = []
    for x in lists:
        bits = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in x) > len(x))
        want.append(bits - (1 << 64) if bits >> 63 else bits)
    assert got == want


def leaks_by_hand(docs, items):
    def counts(words):
        out = {}
        for i in range(max(1, len(words) - 4)):
            key = tuple(words[i : i + 5])
            out[key] = out.get(key, 0) + 1
        return out

    found = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, item in items:
            m = (item or "").lower().split()
            if len(m) < 5 and w != m:
                continue  # too short to look for inside a text
            for s in range(max(1, len(w) - len(m) + 1)) if w and m else ():
                a, b = counts(w[s : s + len(m)]), counts(m)
                same = sum(min(n, b.get(k, 0)) for k, n in a.items())
                sim = same / (sum(a.values()) + sum(b.values()) - same)
                if sim >= 0.8 and sim > found.get((d, i), 0):
                    found[d, i] = sim
    return {k: round(v, 9) for k, v in found.items()}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 3)
    items = [(i, " ".join(word() for _ in range(rng.randrange(6, 60)))) for i in range(30)] + [(90, "a b"), (91, ""), (92, None), (None, "one two three four five six seven")]
    docs = []
    for d in range(200):
        own = [word() for _ in range(rng.randrange(80))]
        if d % 2:
            leak = rng.choice(items[:30])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                leak[rng.randrange(len(leak))] = "changed"
            if d % 5 == 0:
                del leak[rng.randrange(len(leak))]
            at = rng.randrange(len(own) + 1)
            own[at:at] = [x.upper() if d % 3 else x for x in leak]
        docs.append((d, " ".join(own)))
    docs += [(d, t) for d, t, *_ in AWKWARD if d != 7] + [(300, "A B"), (301, "one two three four five six seven"), (5, "x")]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = leaks_by_hand(docs, items)
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == want and len(got) == len(want) > 50


def test_leaks_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert find_leaks(empty(spark), items).count() == 0 and find_leaks(awkward(spark), items.limit(0)).count() == 0


def test_licence_notices(spark):
    docs = [
        (1, "Some prose here.\nReleased under the MIT License.\nMore prose follows."), (2, "LICENSED under CC-BY-NC 4.0"), (3, "all rights reserved"), (4, "MIT"),
        (5, "Licensed under the\nApache License, Version 2.0."), (6, "Nothing of that sort, the license of the road."), (1, "Released under the MIT License."),
    ] + [(d, t) for d, t, *_ in AWKWARD if d not in (1, 2, 3, 5, 6)]
    got = {(r["doc_id"], r["licence"]): (r["dice"], r["n_units"]) for r in scan_licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"): (1.0, 1), (2, "CC-BY-NC-4.0"): (1.0, 1), (3, "Proprietary"): (1.0, 1), (5, "Apache-2.0"): (1.0, 1)}
    assert scan_licences(empty(spark)).count() == 0 and scan_licences(awkward(spark)).count() == 0
    none = spark.createDataFrame([], "template int, licence string, wording string")
    assert scan_licences(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


NEIGHBOURS = {
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License\nas published by the Free "
               "Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\nthe Free "
               "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
                "Free Software Foundation; either version 2.1 of the License, or (at your option)\nany later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
                "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Copyright 2020 Example Inc. Licensed under the MIT License.",
    "Proprietary": "Copyright 2020 Example Inc. All rights reserved.",
}


def test_notices_are_named_beside_their_neighbours_and_inside_a_line(spark):
    docs = spark.createDataFrame([(i, f"Some words before! {text} And some words after it.") for i, text in enumerate(NEIGHBOURS.values())], "doc_id long, text string")
    found = {r["doc_id"]: r["licence"] for r in scan_licences(docs).collect()}
    assert found == dict(enumerate(NEIGHBOURS))
