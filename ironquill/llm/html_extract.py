"""Main text of pages by a linear-chain conditional random field over DOM leaf blocks.

Each block is described by the elements above it and by its text; the field
weighs these and which label follows which, and the best labelling of a page
is decoded by Viterbi. It is trained on labelled pages: a bounded sample of
the table's own whose markup names the article, and the same articles set in
other layouts, so that no single layout is learned by heart.
"""

from __future__ import annotations

import html as entities
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironquill.llm.html_blocks import LABEL, Block, leaf_blocks
from ironquill.llm.shared import cut

#: Pages of the table that the field is trained on, at most, and layouts made of each.
FIT_PAGES = 120
LAYOUTS = 4
_EPOCHS, _RATE, _RIDGE = 8, 0.3, 1e-4
_ARTICLE = frozenset(("article", "main"))
_OTHER = frozenset("nav aside footer header form".split())
_ASIDE = frozenset("advert note talk form side menu".split())


def _bucket(n: int, steps: tuple[int, ...]) -> int:
    return sum(n >= s for s in steps)


def describe(blocks: list[Block]) -> list[list[str]]:
    """Features of each block."""
    out = []
    for n, b in enumerate(blocks):
        found = {f"tag={b.above.nearest_tag}", f"words={_bucket(len(b.words), (2, 4, 8, 15, 30, 60))}", "bias"}
        found |= {f"in={t}" for t in b.above.tags}
        found |= {f"hint={m}" for m in b.above.hints}
        if b.above.hints:
            found.add(f"nearest={b.above.nearest_hint}")
        share = b.linked / max(1, len(b.text))
        found.add(f"linked={_bucket(int(share * 10), (1, 4, 8))}")
        found.add(f"end={'stop' if b.text[-1] in '.!?…\"”»' else 'open'}")
        found.add(f"marks={_bucket(sum(b.text.count(c) for c in '.,;'), (1, 3, 8))}")
        if b.text[0] in "©" or "©" in b.text[:40]:
            found.add("sign")
        found.add(f"place={'first' if n == 0 else 'last' if n == len(blocks) - 1 else 'inner'}")
        out.append(sorted(found))
    return out


class Field:
    """Weights of features and of label pairs; label 1 is the article's."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves

    def scores(self, described: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(described), 2))
        for n, fs in enumerate(described):
            known = [self.index[f] for f in fs if f in self.index]
            out[n] = self.weights[known].sum(axis=0)
        return out

    def decode(self, described: list[list[str]]) -> list[int]:
        """Viterbi: the labelling with the highest score."""
        if not described:
            return []
        s = self.scores(described)
        best, back = s[0], []
        for row in s[1:]:
            ways = best[:, None] + self.moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        labels = [int(best.argmax())]
        for choice in reversed(back):
            labels.append(int(choice[labels[-1]]))
        return labels[::-1]


def _sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def train(pages: list[list[Block]], seed: int = 7) -> Field:
    """Maximum conditional likelihood by adaptive gradient steps, one page at a time."""
    described = [(describe(p), [b.label for b in p]) for p in pages if p]
    names = sorted({f for d, _ in described for fs in d for f in fs})
    index = {f: n for n, f in enumerate(names)}
    field = Field(index, np.zeros((len(names), 2)), np.zeros((2, 2)))
    seen, seen_moves = np.full((len(names), 2), 1e-6), np.full((2, 2), 1e-6)
    coded = [([np.array([index[f] for f in fs]) for fs in d], np.array(y)) for d, y in described]
    order = random.Random(seed)
    for _ in range(_EPOCHS):
        order.shuffle(coded)
        for rows, y in coded:
            s = np.array([field.weights[r].sum(axis=0) for r in rows])
            ahead, after = np.zeros_like(s), np.zeros_like(s)
            ahead[0] = s[0]
            for t in range(1, len(s)):
                ahead[t] = _sum(ahead[t - 1][:, None] + field.moves, 0) + s[t]
            for t in range(len(s) - 2, -1, -1):
                after[t] = _sum(field.moves + (s[t + 1] + after[t + 1])[None, :], 1)
            total = _sum(ahead[-1], 0)
            off = np.eye(2)[y] - np.exp(ahead + after - total)
            for r, g in zip(rows, off, strict=True):
                g = g - _RIDGE * field.weights[r]
                seen[r] += g * g
                field.weights[r] += _RATE * g / np.sqrt(seen[r])
            moves = -_RIDGE * field.moves
            for t in range(1, len(s)):
                moves = moves - np.exp(ahead[t - 1][:, None] + field.moves + (s[t] + after[t])[None, :] - total)
                moves[y[t - 1], y[t]] += 1
            seen_moves += moves * moves
            field.moves += _RATE * moves / np.sqrt(seen_moves)
    return field


def marked(blocks: list[Block]) -> list[Block] | None:
    """The blocks labelled by what the markup says, if it names an article."""
    if not any(b.above.tags & _ARTICLE for b in blocks):
        return None
    for b in blocks:
        b.label = int(bool(b.above.tags & _ARTICLE) and not b.above.tags & _OTHER and not b.above.hints & _ASIDE)
    return blocks


def layouts(article: list[str], asides: list[str], count: int, rng: random.Random) -> list[str]:
    """The article in other layouts, as labelled pages: ``asides`` fill menus, notices, comments and the like."""
    pick = rng.choice

    def line(least: int = 1, most: int = 12) -> str:
        words = pick(asides or ["…"]).split() or ["…"]
        at = rng.randrange(len(words))
        return entities.escape(" ".join(words[at : at + rng.randint(least, most)]))

    def sentence() -> str:
        return entities.escape(pick(asides or ["…"]))

    def menu(tag: str) -> str:
        return f"<{tag}><ul>" + "".join(f'<li><a href="/{i}">{line(1, 3)}</a></li>' for i in range(rng.randint(2, 7))) + f"</ul></{tag.split()[0]}>"

    def box(opening: str, *inner: str) -> str:
        return f'<{opening} {LABEL}="0">{"".join(inner)}</{opening.split()[0]}>'

    out = []
    for _ in range(count):
        top = [box(pick(["header", 'div class="header"', 'div id="masthead"', 'div class="site-header"']), f"<p>{line(2, 8)}</p>", pick(["", menu("nav")]))
               ] if rng.random() < 0.6 else []
        top.append(box(pick(["nav", 'div class="menu"', 'div id="navigation"', 'ul class="nav"']), *(f'<li><a href="/{i}">{line(1, 3)}</a></li>' for i in range(5))))
        notes = [box(pick(['div class="cookie-notice"', 'div class="notice"', 'div role="alert"', 'div id="consent"', 'section class="newsletter"']), f"<p>{sentence()}</p>"),
                 box(pick(['div class="ad"', 'div class="advertisement"', 'div class="promo"', 'aside class="sponsored"']), sentence()),
                 box(pick(["form", 'div class="search-form"', 'form class="login"']), f"<p>{line(2, 6)}</p><label>{line(1, 3)}</label><input>"),
                 box(pick(["aside", 'div class="sidebar"', 'div id="related"', 'div class="widget"']), f"<h3>{line(1, 4)}</h3><p>{sentence()}</p>", menu("div"))]
        rng.shuffle(notes)
        cut_at = rng.randrange(len(notes) + 1)
        body = []
        heading = pick(["h1", "h2"])
        for n, text in enumerate(article):
            tag = heading if n == 0 and len(text) < 120 else pick(["p"] * 6 + ["blockquote", "li", "h2" if len(text) < 80 else "p", "pre"])
            body.append(f"<{tag}>{entities.escape(text)}</{tag}>")
            if rng.random() < 0.08:
                body.append(box(pick(['div class="ad"', 'aside class="pullout"', 'div class="share"', 'div class="promo"']), line(1, 9)))
        wrap = pick(["article", "main", 'div class="content"', 'div id="main"', 'div class="post-body"', 'section class="story"', 'div class="entry"', "div", 'td class="text"'])
        talk = box(pick(['div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div id="discussion"']),
                   f"<h3>{line(1, 3)}</h3>", *(f'<div class="comment"><p>{sentence()}</p></div>' for _ in range(rng.randint(1, 4)))) if rng.random() < 0.6 else ""
        foot = box(pick(["footer", 'div class="footer"', 'div id="footer"']), f"<p>&copy; {line(1, 6)}</p>", pick(["", menu("div")]))
        if rng.random() < 0.12:  # a page that is nothing but its article
            out.append(f"<html><body {LABEL}=\"1\">{''.join(f'<p>{entities.escape(t)}</p>' for t in article)}</body></html>")
            continue
        out.append(f"<html><body>{''.join(top)}{''.join(notes[:cut_at])}<{wrap} {LABEL}=\"1\">{''.join(body)}</{wrap.split()[0]}>"
                   f"{talk}{''.join(notes[cut_at:])}{foot}</body></html>")
    return out


def labelled_pages(pages: list[str], count: int = LAYOUTS, seed: int = 7) -> list[list[Block]]:
    """Pages whose markup names the article, and their articles in other layouts."""
    rng, out = random.Random(seed), []
    for page in pages:
        blocks = marked(leaf_blocks(page))
        if blocks is None:
            continue
        out.append(blocks)
        article, rest = [b.text for b in blocks if b.label], [b.text for b in blocks if not b.label]
        asides = rest + [" ".join(t.split()[:25]) for t in article]
        out += [leaf_blocks(x) for x in layouts(article, asides, count, rng)] if article else []
    return [[b for b in p if b.label is not None] for p in out]


def fit(pages: DataFrame, sample: int = FIT_PAGES, html_col: str = "html") -> Field:
    """A field from up to ``sample`` pages, taken by a hash of their markup; a table with no article trains on layouts alone."""
    taken = pages.filter(f"{html_col} is not null").select(html_col, F.xxhash64(html_col).alias("_order"))
    rows = cut(taken.orderBy("_order", html_col).limit(sample), "pages").collect()  # bounded by ``sample``
    found = labelled_pages([r[0] for r in rows])
    return train(found or labelled_pages([f"<article><h1>A title</h1><p>{'Some words of a text, and more of them. ' * 6}</p></article><nav>Home</nav>"]))


def main_text(html: str | None, field: Field) -> str:
    blocks = leaf_blocks(html)
    return "\n\n".join(b.text for b, y in zip(blocks, field.decode(describe(blocks)), strict=True) if y)


def extracted(pages: DataFrame, field: Field, carry: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns ``carry`` and ``_text`` of every page: its article's blocks joined by two line feeds; empty for a null page."""
    shipped = pages.sparkSession.sparkContext.broadcast((field.index, field.weights, field.moves))  # some hundred features
    source = pages.select(*carry, F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shipped.value)
        for batch in batches:
            texts = pa.array([main_text(x.as_py(), field) for x in batch.column(len(carry))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], texts], [*carry, "_text"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(carry)])
    return source.mapInArrow(run, f"{kept}, _text string")
