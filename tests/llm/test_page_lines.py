"""Which pages are differenced."""

from cutloom.llm.page_text import main_text


def test_pages_of_articles_alone_are_differenced(spark):
    """Pages without a line outside of an article, and pages that share all lines, met no neighbour."""
    rows = [("http://h/a", "<article><p>one</p><p>both</p></article>"), ("http://h/b", "<article><p>two</p><p>both</p></article>"),
            ("http://g/a", "<article><p>x</p></article><p>menu</p>"), ("http://g/b", "<article><p>x</p><p>y</p></article><p>menu</p>"),
            ("http://f/a", "<p>m</p>"), ("http://f/b", "<p>m</p><p>n</p>"), ("http://e/a", "")]
    got = {r.url: (r.main_text, r.n_shared, r.n_restored) for r in main_text(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {"http://h/a": ("one\n\nboth", 1, 1), "http://h/b": ("two\n\nboth", 1, 1), "http://g/a": ("x", 2, 1), "http://g/b": ("x\n\ny", 2, 1),
                   "http://f/a": ("m", 0, 0), "http://f/b": ("n", 1, 0), "http://e/a": ("", 0, 0)}
