"""op9: heads without an end, pages of short texts, deep pages, and blocks against a plain splitting of random pages."""

from __future__ import annotations

import html as entities
import random
import re
import time

import pytest

from gridsla.llm.html import extract

LONG = "The river rose in the night and the whole village went out to look at it. Nobody slept until the rain had stopped."


@pytest.mark.parametrize("page,text", [
    (f"<!DOCTYPE html><html><head><title>t</title><p>{LONG}", LONG),
    (f"<head><meta charset=utf-8><link rel=x><style>p {{}}</style><script>var a</script>{LONG}", LONG),
    (f"<html><head><title>t</title></head><p>{LONG}", LONG),
    (f"<head><noscript><link rel=x></noscript><base href=x><h1>Flood</h1><p>{LONG}", f"Flood\n{LONG}"),
    ("<body><p>Yes.</p><p>No.</p>", "Yes.\nNo."),
    ("plain &amp; short", "plain & short"),
    ("<nav><a href=x>Home</a></nav><p><a href=y>More</a></p>", ""),
    ("<head><title>only a title</title></head>", ""),
    ("", ""), (None, ""),
])
def test_small_pages(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("tag", ["div", "blockquote", "div class=sidebar", "header", "p"])
def test_deep_pages_take_time_in_proportion(tag):
    def page(n):
        return "".join(f"<{tag}>{LONG} {k}" for k in range(n))
    extract(page(100))
    start = time.process_time()
    text = extract(page(20_000))
    assert time.process_time() - start < 20  # 4,000 took 6 s when every block kept its path
    assert text.count("\n") in (19_999, 0)


def test_blocks_equal_a_plain_splitting():
    rng = random.Random(8)
    for _ in range(60):
        page, plain = [], []
        for _ in range(rng.randint(1, 12)):
            block = rng.choice(["p", "div", "section", "li", "blockquote"])
            words = [rng.choice(["stone", "r&b", "<3", "Ünïcode", "“so”", "river"]) for _ in range(rng.randint(14, 30))]
            inner = entities.escape(" ".join(words), quote=False)
            inner = inner.replace(" river", rng.choice([" <b>river</b>", "<br>river", "\n\t river", " ri<!-- x -->ver"]))
            page.append(f"<{block}>{inner}. And then it ended. So it was.</{block}>")
            plain.append(" ".join(entities.unescape(re.sub(r"<br>", " ", re.sub(r"<!--.*?-->|</?b>", "", inner))).split())
                         + ". And then it ended. So it was.")
        assert extract(f"<html><body><main>{''.join(page)}</main></body></html>") == "\n".join(plain)
