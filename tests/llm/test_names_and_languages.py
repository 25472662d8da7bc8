from __future__ import annotations

import pytest

from wayfold.llm import html_blocks

BODY = "<article><p>The text.</p></article>"
POLISH = "Wczoraj wieczorem pociąg przyjechał punktualnie, więc wszyscy pasażerowie zdążyli wrócić przed zmrokiem."
JAPANESE = "昨日の夜、電車は時間通りに到着したので、乗客は全員暗くなる前に家に帰ることができました。"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body class='single no-sidebar'>" + BODY, "The text."),
        ("<html class='has-sidebar'><body class='sidebar cookies'><main>x</main>", "x"),
        ("<div class='layout-right-sidebar'><div id=content><p>y</p></div></div>", "y"),
        ("<div id='page' class='site with-sidebar'>" + BODY + "</div>", "The text."),
        ("<div class='sidebar'><p>Side</p>" + BODY + "<p>Side</p></div>", "The text."),
        ("<article><p>In</p><div id='comments'><article class='comment'>No</article></div></article>", "In"),
        ("<div id='comments'><article class='comment'>No</article></div>" + BODY, "The text."),
        ("<main>x<div class='main-navigation'>No</div><div class='widget-area'>No</div><div class='cookie-notice'>No</div></main>", "x"),
        (f"<nav>Menu</nav><div><p>{POLISH}</p></div>", POLISH),
        (f"<ul><li><a href=x>link</a></ul><div><p>{JAPANESE}</p></div>", JAPANESE),
    ],
)
def test_names_and_languages_do_not_drop_a_page(page, text):
    assert html_blocks.main_text(page) == text
