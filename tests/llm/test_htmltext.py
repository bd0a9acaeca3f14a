"""Pages whose article stands in no telling element, text beside all elements, and markup that never ends."""

from __future__ import annotations

import time

import pytest

from volumetra.llm import htmltext

ONE = "The river had been rising since early morning, and by noon the lower fields were under water."
TWO = "Nobody in the village could remember a spring like it, though the older ones tried."
THREE = "By evening the bridge was closed, and the only road left led over the hill."
ARTICLE = f"<h1>The flood</h1><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
WANT = "\n\n".join(["The flood", ONE, TWO, THREE])
NAV = "<nav><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></nav>"
LINKS = "<div><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></div>"

PAGES = {
    "bare body": f"<html><body>{NAV}{ARTICLE}<footer>Copyright 2020 Site</footer></body></html>",
    "bare body, aside after": f"<html><head><title>x</title></head><body><header><a href=/>Site</a></header>{ARTICLE}<aside>More to read</aside><footer><p>Copyright 2020 Site</p></footer></body></html>",
    "bare body, advert within": f"<html><body>{NAV}<h1>The flood</h1><p>{ONE}</p><aside>Advert: buy an umbrella</aside><p>{TWO}</p><p>{THREE}</p><form><input><button>Sign up</button></form></body></html>",
    "bare body, comments": f"<html><body>{NAV}{ARTICLE}<div class=comments><p>{TWO}</p></div><footer>x</footer></body></html>",
    "unnamed divs": f"<html><body>{LINKS}<div><div><div>{ARTICLE}</div></div></div><div>Copyright 2020</div></body></html>",
    "unnamed divs around all": f"<html><body><div><div>{LINKS}</div><div><div>{ARTICLE}</div></div><div>Copyright 2020</div></div></body></html>",
    "unnamed columns": f"<html><body>{LINKS}<div><div>{ARTICLE}</div><div><ul><li><a href=/>One</a></li><li><a href=/>Two</a></li></ul></div></div><div>Copyright</div></body></html>",
    "layout table": f"<html><body><table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td>{ARTICLE}</td></tr></table></body></html>",
    "aside within": f"<html><body>{NAV}<article><h1>The flood</h1><p>{ONE}</p><aside><p>Read also: what to do when it rains</p></aside><p>{TWO}</p><p>{THREE}</p></article><footer>x</footer></body></html>",
    "related list within": f'<html><body>{NAV}<main>{ARTICLE}<div class="related-posts"><h2>Related</h2><ul><li><a href=/1>One more</a></li><li><a href=/2>Another one</a></li></ul></div></main><footer>x</footer></body></html>',
    "noscript in the body": f"<html><body><noscript>Please turn on scripts.</noscript>{NAV}<article>{ARTICLE}</article><footer>x</footer></body></html>",
    "text before all elements": f"Cookie notice<div class=menu><a href=/>Home</a></div><article>{ARTICLE}</article>",
    "text after all elements": f"<article>{ARTICLE}</article>All rights reserved",
    "quotes": f"<article><h1 class=it's>The flood</h1><p title=\"a > b\">{ONE}</p><p x=\"a\"\">{TWO}</p><p title='>{THREE}</p></article>",
    "tag without its end": f"<article>{ARTICLE}</article><div class='x",
}


@pytest.mark.parametrize("name", PAGES)
def test_frames(name):
    assert htmltext.extract([PAGES[name]], htmltext.trained()) == [WANT]


@pytest.mark.parametrize("unit", ["<a", "<a b='", '<a ">" ', "=\"<a ='", "<!-", "<svg", "</p", "<a b=''"])
def test_a_megabyte_without_end_is_one_pass(unit):
    model = htmltext.trained()
    start = time.monotonic()
    htmltext.extract([unit * (1_000_000 // len(unit))], model)
    assert time.monotonic() - start < 3
