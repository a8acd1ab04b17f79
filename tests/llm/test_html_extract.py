import random
import time

import pytest

from ironquill.llm import html_extract as H
from ironquill.llm.html_blocks import leaf_blocks


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.1/pages.parquet")


@pytest.fixture(scope="module")
def field(pages):
    return H.fit(pages, sample=40)


def test_held_out_pages_and_layouts(pages, field):
    rows = [r["html"] for r in pages.filter("page_id >= 1000 and page_id < 1060").collect()]
    right = whole = total = 0
    labelled = H.labelled_pages(rows, 4, seed=99)
    for blocks in labelled:
        want, got = [b.label for b in blocks], field.decode(H.describe(blocks))
        right += sum(a == b for a, b in zip(want, got, strict=True))
        total += len(want)
        whole += want == got
    assert right / total > 0.99 and whole / len(labelled) > 0.95


def test_blocks():
    html = """<!DOCTYPE html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- no -->
        <p><b>Bold &amp; &eacute;t&#233;&nbsp;<br>line<p>Second <i>one</i></p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>tail<noscript>x</noscript>"""
    assert [b.text for b in leaf_blocks(html)] == ["Bold & été line", "Second one", "a", "b", "c", "d", "tail"]
    assert leaf_blocks(None) == [] and leaf_blocks("") == [] and leaf_blocks("<p> \n </p>") == []
    assert [b.text for b in leaf_blocks("<p>unclosed <a href='x'>link")] == ["unclosed link"]


def texts(html):
    return [b.text for b in leaf_blocks(html)]


def test_omitted_tags_lose_no_text():
    assert texts("<html><head><title>t</title><body><article><p>Hello world.") == ["Hello world."]
    assert texts("<head><meta charset=x><title>t</title><style>p{}</style><p>Hello") == ["Hello"]
    assert texts("<head><title>t</title> \n Hello <i>there</i>") == ["Hello there"]
    assert texts("<head><noscript><img src=x><p>no</noscript><title>t</title></head>Hello") == ["Hello"]
    assert texts("<body><button>Menu<article><p>Hello.") == ["Hello."] == texts("<select><option>a<option>b<p>Hello.")
    assert texts("<p>Let <math><mi>x</mi></math> be <object>an</object> <video>odd</video> <svg><text>one</text></svg>") == ["Let x be an odd one"]
    assert texts("<p>a</x></p>b</head>c<div>d</i></div>e") == ["a", "bc", "d", "e"]
    assert texts("<div>a<button>b</div>c<p>d<button>e<div>f</div></button>g</p>h<noscript><div>i</div></noscript>j") == ["a", "c", "dg", "hj"]
    assert texts("<form><label>l</label><button>Go <b>on</b></button><textarea>t<p>u</textarea> v</form>w") == ["l v", "w"]


def test_blocks_against_an_element_tree():
    """Well-formed trees: a block is the text between two boundaries of block elements, without that of silent ones."""
    rng = random.Random(11)

    def tree(depth):
        out = []
        for _ in range(rng.randrange(4)):
            kind = rng.random()
            if kind < 0.4 or depth > 6:
                out.append(rng.choice(["one", "two &amp; ", " three ", "\n"]))
            else:
                tag = rng.choice(["div", "section", "blockquote", "span", "i", "math", "x-y", "script", "noscript", "textarea"])
                out.append((tag, ["js"] if tag == "script" else tree(depth + 1)))
        return out

    def written(nodes):
        return "".join(n if isinstance(n, str) else f"<{n[0]} class=c>{written(n[1])}</{n[0]}>" for n in nodes)

    def plain(nodes, silent=False):
        for n in nodes:
            if isinstance(n, str):
                yield "" if silent else n.replace("&amp;", "&")
            else:
                edge = "\0" if not silent and n[0] in ("div", "section", "blockquote") else ""
                yield edge
                yield from plain(n[1], silent or n[0] in ("script", "noscript", "textarea"))
                yield edge

    for _ in range(300):
        nodes = tree(0)
        assert texts(written(nodes)) == [t for x in "".join(plain(nodes)).split("\0") if (t := " ".join(x.split()))]


def test_depth_costs_no_square():
    start = time.perf_counter()
    blocks = leaf_blocks('<div class="a b"><p>x' * 10_000 + "<span>" * 10_000 + "<p>y</q>" * 10_000)
    assert len(H.describe(blocks)) == 20_000 and time.perf_counter() - start < 5
    assert all(len(b.above.tags) + len(b.above.hints) < 10 for b in blocks)  # what stands above, not a copy of the stack


def test_viterbi_is_the_best_labelling(field):
    rng = random.Random(2)
    names = sorted(field.index)
    for n in range(1, 8):
        rows = [[rng.choice(names) for _ in range(3)] for _ in range(n)]
        s = field.scores(rows)
        score = lambda y, s=s: sum(s[i][a] for i, a in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False))
        best = max((tuple(k >> i & 1 for i in range(n)) for k in range(1 << n)), key=score)
        assert score(field.decode(rows)) == pytest.approx(score(best))


def test_odd_pages(spark, field):
    rows = [(1, "u", None, 0), (1, "u", "", 0), (None, None, "<p>" * 3000, 0), (2, "u", "<article><p>" + "word and word, more. " * 20_000, 0)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, _text int")
    got = sorted(len(r["_text"]) for r in H.extracted(odd, field).collect())
    assert got[:3] == [0, 0, 0] and got[3] == len(("word and word, more. " * 20_000).strip())
    assert H.extracted(odd.limit(0), field).count() == 0
    assert H.fit(odd.limit(0)).decode([["tag=p"]]) in ([0], [1])
