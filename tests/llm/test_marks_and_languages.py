"""Names that mark what is no article text, and languages with few labelled rows."""

import pytest

from ledgerloom.llm.html_extract import main_text
from ledgerloom.llm.language_id import train


@pytest.mark.parametrize(
    "html, text",
    [
        ('<article><p>own</p></article><div class="comments-list"><article>reader</article></div>', "own"),
        ('<article><p>own</p><div class="reader-comments"><p>reader</p></div></article>', "own"),
        ('<article><div class="ad-wrap">x</div><div class="advert-box">y</div><div id="ad1">z</div><p>own</p></article>', "own"),
        ('<article><p class="social">own</p><div class="search">more</div><math><mi>x</mi></math></article>', "own\nmore\nx"),
        ('<p>own</p><div class="search">box</div><div class="social">links</div>', "own"),
        ('<article><div class="ad-free">own</div><div class="adverse">b</div><p class="commentary">c</p><div class="add">d</div></article>', "own\nb\nc\nd"),
        ('<article><p class="no-comments-yet">a</p><h2 id="comment-on-law">b</h2></article>', "a\nb"),
    ],
)
def test_marks(html, text):
    assert main_text(html) == text


def test_rare_languages_have_a_class(spark):
    rows = [("same text again", "en")] * 3000 + [(f"plain words number {i}", "en") for i in range(3000)] + [("ein seltener satz", "de"), ("", "xx"), (None, "yy"), ("no label", None)]
    labelled = spark.createDataFrame(rows, "text string, label string")
    languages, logs = train(labelled, 40)
    assert languages == ["de", "en"] and logs.shape[1] == 2
    assert train(labelled.limit(0), 40)[0] == []
