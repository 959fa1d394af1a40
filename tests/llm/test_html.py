"""Layouts that a page's main text has to survive, deep pages, and the tag-path ratios by hand."""

import random
import re
import time

import numpy as np
import pytest

from wardflow.llm.html_text import CONTAINERS, PUNCTUATION, main_text, nodes, path_scores

P = "A long paragraph of the article, with commas, and more words."
ARTICLE = "<article><h1>Title here</h1>" + f"<p>{P}</p>" * 5 + "</article>"
WHOLE = "\n".join(["Title here", *[P] * 5])
COMMENT = '<article class="comment"><p>I say, this is a comment, long enough to look like text, yes.</p></article>'

LAYOUTS = {
    "a form around the page": (f'<body><form id="aspnetForm"><div>{ARTICLE}</div><input></form></body>', WHOLE),
    "a nav that is not closed": (f"<body><nav><ul><li><a href=x>Home</a><li><a>About</a></ul>{ARTICLE}</body>", WHOLE),
    "comments beside the text": (f"<main>{ARTICLE}{COMMENT}</main>", WHOLE),
    "comments after the article": (f"{ARTICLE}{COMMENT}", WHOLE),
    "comments inside the article": (ARTICLE.replace("</article>", f"{COMMENT}</article>"), WHOLE),
    "a section named related": (ARTICLE.replace("</article>", '<section id="related"><h2>Related work</h2><p>Others did this, and that, before.</p></section></article>'),
                                WHOLE + "\nRelated work\nOthers did this, and that, before."),
    "related posts": (ARTICLE.replace("</article>", '<div class="related-posts"><p>Another post, and one more, to read.</p></div></article>'), WHOLE),
    "cards in an aside": (f'{ARTICLE}<aside><article class="card"><p>Teaser of another article, short.</p></article></aside>', WHOLE),
    "a search form": (f"{ARTICLE}<form><p>Search, the site, now.</p></form>", WHOLE),
    "a form without an article": ("<body><form><div>" + f"<p>{P}</p>" * 5 + "</div></form></body>", "\n".join([P] * 5)),
    "a script in a form": (f"<form><script>var a = '{P}';</script>{ARTICLE}<select><option>{P}</select></form>", WHOLE),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    page, want = LAYOUTS[layout]
    assert main_text(page) == want


@pytest.mark.parametrize("page, least", [("<div>" * 100_000 + "text, of it.", 12), ('<div class="x"><p>some text, and more.' * 25_000, 500_000), ("<b><i>" * 80_000 + P, len(P)),
                                         ("</div>" * 100_000 + P, len(P)), ("<ul><li>" * 50_000 + P + "</li></ul>" * 50_000, len(P))])
def test_deep_pages_take_linear_time(page, least):
    start = time.process_time()
    assert len(main_text(page)) >= least
    assert time.process_time() - start < 4


def random_page(seed):
    pick, out, opened = random.Random(seed), [], []
    for _ in range(120):
        kind = pick.random()
        if kind < 0.35:
            tag = pick.choice(["div", "section", "article", "ul", "blockquote"])
            opened.append(tag)
            out.append(f"<{tag}>")
        elif kind < 0.6 and opened:
            out.append(f"</{opened.pop()}>")
        else:
            words = " ".join(pick.choice(["word", "words,", "more.", "text"]) for _ in range(pick.randrange(1, 30)))
            out.append(pick.choice(["<p>{}</p>", "{} <br>", "<li>{}</li>", "<h2>{}</h2>"]).format(words))
    return "<html><body>" + "".join(out)


def scores_by_hand(found):
    """Mean length and punctuation of each path, at least those of the outermost container, smoothed and multiplied."""
    def path(e):
        return (*path(e.parent), e.tag) if e.parent else ()

    paths = [path(x.element) for x in found]
    outers = [next((p[: i + 1] for i, t in enumerate(p) if t in CONTAINERS), None) for p in paths]
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    kernel /= kernel.sum()
    smoothed = []
    for measure in (len, lambda t: len(PUNCTUATION.findall(t))):
        own = []
        for p, o in zip(paths, outers):
            same = [measure(x.text) for x, q in zip(found, paths) if q == p]
            values = [sum(same) / len(same)]
            if o is not None:
                weighted = [(len(x.text), measure(x.text)) for x, q in zip(found, outers) if q == o]
                values.append(sum(n * v for n, v in weighted) / sum(n for n, _ in weighted))
            own.append(max(values))
        padded = [own[0]] * 2 + own + [own[-1]] * 2
        smoothed.append([sum(kernel[j] * padded[i + j] for j in range(5)) for i in range(len(own))])
    return [(c * (1 + m)) ** 0.5 for c, m in zip(*smoothed)]


@pytest.mark.parametrize("seed", range(12))
def test_scores_are_the_ratios_of_tag_paths(seed):
    found, elements = nodes(random_page(seed))
    assert len(found) > 10 and [e.number for e in elements] == list(range(len(elements)))
    assert np.allclose(path_scores(found), scores_by_hand(found), rtol=1e-9)
    for e in elements[1:]:  # what stands inside an element is numbered after it
        assert e.parent.number < e.number <= e.last <= e.parent.last


def test_text_is_whole():
    text = main_text(ARTICLE.replace(P, "x &amp; y" + " z," * 30_000))
    assert len(re.findall("z,", text)) == 150_000 and "x & y" in text
