"""The line-block distribution: surges and dives against brute force, and what only weights and windows can decide."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestar.llm import html_extract

STORY = ["The bridge over the river was built by the people of the town in a single dry summer.", "It stood long.", "Then, one night in March, the water rose above the road and took three of its arches away."]
BODY = "".join(f"<p>{p}</p>" for p in STORY)


def brute_region(weights, headings, window, least):
    """Line i is kept if a surge at or before it and a heavy line at or after it have no dive between them."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    least = min(least, max(sums) / 2)
    heavy = [w * window >= least and w > 0 for w in weights]
    begins = [i for i in range(n) if sums[i] >= least and (heavy[i] or headings[i] and weights[i])]
    dives = [i for i in range(n) if 2 * sums[i] < least]
    return [weights[i] > 0 and any(b <= i <= e and not any(b <= j < e for j in dives) for b in begins for e in range(i, n) if heavy[e]) for i in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_regions_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 30))
    weights = (rng.integers(0, 90, n) * (rng.random(n) < 0.6)).astype(np.int64)
    headings = (rng.random(n) < 0.2).tolist()
    if weights.any():
        assert html_extract.region_lines(weights, headings, 3, 86).tolist() == brute_region(weights.tolist(), headings, 3, 86)


@pytest.mark.parametrize(
    "page",
    [
        f"<nav>Home News Sport</nav><article class='post related-work'>{BODY}</article><footer>f</footer>",
        f"<ul><li><a href=/>Home</a></li></ul><div class='banner-story'>{BODY}</div>",
        f"<main>{BODY}<div class=alert>The town has asked the county for a new one.</div></main>",
        f"<article><p>Also read this</p></article><div>{BODY}</div>",
        f"<div>{BODY}</div><div>&copy; 2024 The Daily Bridge Company, all rights reserved, no part may be used without written consent</div>",
        f"<article>{BODY}<div class=comments><p>{'me too ' * 90}</p></div></article>",
        f"<div class='comments-area'><p>{'me too ' * 90}</p></div><div class=x>{BODY}</div>",
        f"<article>{BODY}</article><div>Short note outside</div>",
    ],
)
def test_article_is_found(page):
    assert html_extract.main_text(page) == "\n\n".join(STORY)


def test_only_readers_comments_give_nothing():
    assert html_extract.main_text(f"<div class=comments><p>{'me too ' * 90}</p></div>") == ""


def test_every_page_goes_through_the_windows(monkeypatch):
    """Pages that name an article too: with windows that keep nothing, nothing is left of any."""
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    assert all(map(html_extract.main_text, pages))
    monkeypatch.setattr(html_extract, "region_lines", lambda weights, *_: np.zeros(len(weights), bool))
    assert not any(map(html_extract.main_text, pages))
