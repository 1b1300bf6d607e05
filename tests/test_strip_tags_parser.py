"""X-6: the one-pass regex tag stripper equals the stdlib parser's text data (entity
references dropped, script/style text kept) on every derived page of sf0.001."""

from html.parser import HTMLParser

from conftest import SF_SMALL
from quillstat.functions import text as TX
from quillstat.plans import derived as D


class _Data(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.parts = []

    def handle_data(self, d):
        self.parts.append(d)


def _text_data(html: str) -> str:
    p = _Data()
    p.feed(html)
    p.close()
    return "".join(p.parts)


def test_strip_tags_matches_parser(spark):
    rows = D.pages(spark, SF_SMALL).select("stories_id", "html", TX.strip_tags("html").alias("t")).collect()
    assert rows
    bad = [r.stories_id for r in rows if r.t != _text_data(r.html)]
    assert not bad, bad[:5]
