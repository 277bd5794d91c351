from tidewire.sources import html


def test_an_article_behind_much_markup_is_found():
    menu = "".join(f'<div class="item">{i}</div>' for i in range(2000))
    body = "word " * 200
    for element in ("<article>{}</article>", '<p itemprop="articleBody">{}</p>', '<div class="x press-release">{}</div>'):
        assert html.main_text(f"<div>{menu * 2}</div>" + element.format(body)) == body.strip()


def test_the_longest_of_the_first_blocks_is_the_fallback():
    few = "".join(f"<div>{i}</div>" for i in range(html.MOST_BLOCKS - 1))
    assert html.main_text(few + "<div>the longest</div>" + "<div>longer but too late</div>") == "the longest"


def test_pages_query(spark, sf_dir):
    """Title and text of every page, by Python's own parser."""
    from html.parser import HTMLParser

    from tidewire.plans import catalog

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.tags, self.title, self.words = [], "", []

        def handle_starttag(self, tag, attrs):
            self.tags.append(tag)

        def handle_endtag(self, tag):
            if tag in self.tags:
                del self.tags[len(self.tags) - 1 - self.tags[::-1].index(tag) :]

        def handle_data(self, data):
            if "title" in self.tags:
                self.title += data
            elif not {"script", "style", "head", "noscript"} & set(self.tags):
                self.words += data.split()

    out = {r.page_id: r for r in catalog.QUERIES["html_pages"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert out.keys() == {r.page_id for r in pages}
    for r in pages:
        p = Plain()
        p.feed(r.html or "")
        text = [w for k, v in out[r.page_id].asDict().items() if isinstance(v, str) and k not in ("title", "url", "company_name", "release_time_text") for w in v.split()]
        assert (out[r.page_id].title or "").split() == p.title.split()
        assert set(text) <= set(p.words)  # nothing but what the page shows
